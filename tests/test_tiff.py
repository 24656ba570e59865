import struct
import zlib

import numpy as np
import pytest
from cellspark.sources import tiff
from pyspark.sql.datasource import EqualTo


def lzw(data):
    """Encoder of the same codes, for round trips."""
    out, bits, have = bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(256)}, 9

    def put(code):
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have)
            bits &= (1 << have) - 1

    put(256)
    size, word = 258, b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = size
        size += 1
        if size == 4094:
            put(256)
            table, width, size = {bytes([j]): j for j in range(256)}, 9, 258
        else:
            width = (size).bit_length()
        word = data[i : i + 1]
    if word:
        put(table[word])
        size += 1
        width = min(12, size.bit_length())
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def packbits(data):
    out = bytearray()
    for at in range(0, len(data), 100):
        part = data[at : at + 100]
        if len(set(part)) == 1 and len(part) > 1:
            out += bytes([257 - len(part)]) + part[:1]
        else:
            out += bytes([len(part) - 1]) + part
    return bytes(out)


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32946: zlib.compress, 32773: packbits}


def make(a, packing=1, order="<", big=False, planar=False, tile=None, rows=None, differences=False):
    """A TIFF file of a height x width x channels array."""
    h, w, c = a.shape
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    size = tile or (rows or h, w)
    segments = []
    for plane in [a[..., k : k + 1] for k in range(c)] if planar else [a]:
        for top in range(0, h, size[0]):
            for left in range(0, w, size[1]):
                part = plane[top : top + size[0], left : left + size[1]]
                if tile:
                    full = np.zeros((*tile, part.shape[2]), a.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                if differences:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                segments.append(PACK[packing](np.ascontiguousarray(part, a.dtype.newbyteorder(order)).tobytes()))
    head = 16 if big else 8
    offsets = np.cumsum([head, *map(len, segments)]).tolist()
    tags = [(256, [w]), (257, [h]), (258, [a.dtype.itemsize * 8] * c), (259, [packing]), (277, [c]), (284, [2 if planar else 1]), (317, [2 if differences else 1]), (339, [kind] * c)]
    tags += [(322, [tile[1]]), (323, [tile[0]]), (324, offsets[:-1]), (325, [len(s) for s in segments])] if tile else [(273, offsets[:-1]), (278, [size[0]]), (279, [len(s) for s in segments])]
    code, width, inline, entry = ("Q", 16, 8, "HHQ") if big else ("I", 4, 4, "HHI")
    at = offsets[-1]
    extra_at = at + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
    table, extra = b"", b""
    for tag, values in sorted(tags):
        data = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(data) > inline:
            place = struct.pack(order + code, extra_at + len(extra))
            extra += data
        else:
            place = data.ljust(inline, b"\0")
        table += struct.pack(order + entry, tag, width, len(values)) + place
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return start + b"".join(segments) + struct.pack(order + ("Q" if big else "H"), len(tags)) + table + struct.pack(order + ("Q" if big else "I"), 0) + extra


RNG = np.random.default_rng(5)
FORMS = {
    "plain": dict(), "motorola": dict(order=">"), "strips": dict(rows=4, packing=8), "old": dict(rows=5, packing=32946), "lzw": dict(rows=3, packing=5), "bits": dict(packing=32773, rows=2),
    "tiles": dict(tile=(16, 32), packing=5), "planar": dict(planar=True, rows=4), "planar_tiles": dict(planar=True, tile=(16, 16), packing=8), "big": dict(big=True, tile=(16, 16)), "big_motorola": dict(big=True, order=">", rows=7),
    "differences": dict(differences=True, packing=5, rows=6), "tiled_differences": dict(differences=True, tile=(16, 16), packing=8, order=">"),
}


def picture(dtype):
    a = RNG.integers(0, 200, (37, 45, 3)) // np.array([1, 60, 7])
    return (a / 8).astype(dtype) if np.dtype(dtype).kind == "f" else a.astype(dtype)


def test_every_form_comes_back(spark, tmp_path):
    want = {}
    for i, (name, form) in enumerate(FORMS.items()):
        a = picture([np.uint8, np.uint16, np.int32, np.uint32][i % 4])
        want[name] = a
        (tmp_path / f"{name}.tif").write_bytes(make(a, **form))
    for name, dtype in (("single", np.float32), ("double", np.float64)):
        want[name] = picture(dtype)
        (tmp_path / f"{name}.tif").write_bytes(make(want[name], rows=9))
    df = tiff.read_tiffs(spark, str(tmp_path), split_bytes=1500)
    assert df.rdd.getNumPartitions() > 2 * len(want)  # a file is the work of many tasks
    rows = df.toPandas()
    assert rows["error"].isna().all()
    for name, a in want.items():
        own = rows[rows["image"] == name]
        assert len(own) == a.size, name
        back = np.zeros(a.shape)
        back[own["y"], own["x"], own["c"]] = own["v"]
        assert (back == a).all(), name


def test_channels_are_pruned_where_they_lie(spark, tmp_path):
    a = picture(np.uint8)
    first = zlib.compress(a[..., 0].tobytes())
    (tmp_path / "a.tif").write_bytes(make(a, planar=True, packing=8).replace(first, b"!" * len(first)))  # its first plane can't be read
    (tmp_path / "b.tif").write_bytes(make(a))
    got = tiff.read_tiffs(spark, str(tmp_path), channels=[1, 2])
    assert got.where("error is not null").count() == 0
    assert {r.c: r.n for r in got.groupBy("c").agg({"v": "count"}).withColumnRenamed("count(v)", "n").collect()} == {1: 2 * 37 * 45, 2: 2 * 37 * 45}
    assert tiff.read_tiffs(spark, str(tmp_path)).where("error is not null").select("image").collect()[0].image == "a"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = tiff.read_tiffs(spark, str(tmp_path)).where("c = 2")
        assert pushed.count() == 2 * 37 * 45
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = tiff.PushingTiffReader({"path": str(tmp_path), "channels": "1,2"})
    assert len(list(reader.pushFilters([EqualTo(("c",), 2)]))) == 1 and reader.wanted == {2}


def test_bad_files_are_rows_and_an_empty_folder_raises(spark, tmp_path):
    good = make(picture(np.uint8))
    files = {"none": b"", "text": b"no image at all", "short": good[:500], "odd": good.replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, 7)), "good": good}
    for name, data in files.items():
        (tmp_path / f"{name}.tif").write_bytes(data)
    rows = tiff.read_tiffs(spark, str(tmp_path))
    assert {r.image for r in rows.where("error is not null").collect()} == {"none", "text", "short", "odd"}
    assert rows.where("image = 'good' and error is null").count() == 37 * 45 * 3
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="FileNotFoundError"):
        tiff.read_tiffs(spark, str(tmp_path / "empty")).count()


def test_codecs():
    for data in (b"", b"a", b"aaaaaaaaaa" * 50, bytes(RNG.integers(0, 4, 20_000).astype(np.uint8)), bytes(RNG.integers(0, 256, 30_000).astype(np.uint8))):
        assert tiff.unlzw(lzw(data)) == data
        assert tiff.unpackbits(packbits(data)) == data

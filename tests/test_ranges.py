"""Records of one size, read by many tasks that seek."""

import gzip
import struct

import numpy as np
import pytest

from strandmill.sources import binary


def map_file(n, width=128):
    head = struct.pack("<ii", -1, 2) + b"".join(struct.pack("<i", len(x)) + x for x in (b"a\0", b"chrB\0")) + struct.pack("<Q", n)
    return head + b"".join(struct.pack(f"<{width}s8BIIi36s", bytes([1 << 6 | 30, 0, 3 << 6 | 10]), 3, 60, 1, 2, 3, 4, 0, 0, k % 2, k << 1 | 1, 0, b"r%d" % k) for k in range(n))


def test_map_in_ranges(spark, tmp_path):
    path = tmp_path / "m.map"
    path.write_bytes(map_file(1000))
    rows = binary.read_maq(spark, [str(path)], split=10_000)
    assert rows.rdd.getNumPartitions() > 15
    want = [(k + 1, f"r{k}", ("a", "chrB")[k % 2], k + 1) for k in range(1000)]
    take = lambda df: sorted((r.row_ix, r.id, r.chromosome, r.position) for r in df.collect())
    assert take(rows) == want and take(binary.read_maq(spark, [f"file://{path}"], limit=77, split=10_000)) == want[:77]
    (tmp_path / "z").write_bytes(gzip.compress(map_file(1000)))
    assert take(binary.read_maq(spark, [str(tmp_path / "z")])) == want
    (tmp_path / "cut").write_bytes(map_file(10)[:-5])
    with pytest.raises(Exception, match="unexpected end"):
        binary.read_maq(spark, [str(tmp_path / "cut")]).collect()


def test_intensities_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for tile, n in ((1, 23), (2, 7)):
        (tmp_path / f"s_3_{tile:04d}_pos.txt").write_text("".join(f"{k}.5 {tile}.0\n" for k in range(n)))
        for c in (1, 2, 3):
            d = tmp_path / "L003" / f"C{c}.1"
            d.mkdir(parents=True, exist_ok=True)
            for ext in ("cif", "cnf"):
                v = rng.integers(-500, 500, (4, n)).astype("<i2")
                want[tile, c, ext] = v.T
                (d / f"s_3_{tile}.{ext}").write_bytes(b"CIF" + struct.pack("<BBHHI", 1, 2, c, 1, n) + v.tobytes())
    rows = binary.read_cif(spark, str(tmp_path), 3, [1, 2, 3], [1, 2], clusters=5).orderBy("row_ix").collect()
    assert [r.row_ix for r in rows] == list(range(1, 31)) and [(r.tile, r.x) for r in rows] == [(1, k + 0.5) for k in range(23)] + [(2, k + 0.5) for k in range(7)]
    for r in rows:
        for ext, got in (("cif", r.intensity), ("cnf", r.error)):
            assert got == [want[r.tile, c, ext][int(r.x)].tolist() for c in (1, 2, 3)]
    (tmp_path / "L003" / "C2.1" / "s_3_2.cif").write_bytes(b"CIF" + struct.pack("<BBHHI", 1, 2, 2, 1, 6) + bytes(48))
    with pytest.raises(Exception, match="cluster counts differ"):
        binary.read_cif(spark, str(tmp_path), 3, [1, 2, 3], [1, 2]).collect()

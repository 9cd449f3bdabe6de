"""Invariants of the image engine: exact regions, bounded errors, partitions, round trips."""

import numpy as np
import pytest

from tessera.config import ConfigError, PipelineConfig, resolve_mode
from tessera.functions import codec, imaging, tiles
from tessera.operators import compress, quadtree, raster
from tessera.sources import archive


def picture(h=96, w=80, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    disc = (y - h // 2) ** 2 + (x - w // 2) ** 2 <= (min(h, w) // 4) ** 2
    rgb = np.where(disc[..., None], [240, 220, 20], [40, 90, 160]) + rng.integers(-2, 3, (h, w, 3))
    return rgb.clip(0, 255).astype(np.uint8), disc.astype(np.uint8)


@pytest.mark.parametrize("criterion", ["range", "variance"])
@pytest.mark.parametrize("size", [(96, 80), (137, 61), (1, 1), (5, 64)])
def test_leaves_partition_and_keep_roi(criterion, size):
    rgb, mask = picture(*size)
    leaf = tiles.leaves(rgb, mask, 12, criterion)
    seen = np.zeros(mask.shape, int)
    for x, y, w, h in zip(*(leaf[c] for c in "xywh")):
        seen[y : y + h, x : x + w] += 1
    assert (seen == 1).all()
    back = tiles.paint(*(leaf[c] for c in "xywh"), leaf["value"], *mask.shape)
    assert (back[mask == 1] == rgb[mask == 1]).all()
    if criterion == "range":
        assert np.abs(back.astype(int) - rgb)[mask == 0].max(initial=0) <= 12


def test_leaves_equal_recursion():
    def split(a, m, x, y, n, out, T):
        block, roi = a[y : y + n, x : x + n].reshape(-1, 3), m[y : y + n, x : x + n].any()
        if n == 1 or (not roi and (block.max(0) - block.min(0)).max() <= T):
            out.append((x, y, n))
            return
        k = n // 2
        for dy in (0, k):
            for dx in (0, k):
                split(a, m, x + dx, y + dy, k, out, T)

    for seed in range(5):
        rng = np.random.default_rng(seed)
        rgb = (rng.integers(0, 4, (32, 32, 3)) * 8 * (rng.random((32, 32, 1)) < 0.2)).astype(np.uint8)
        mask = (rng.random((32, 32)) < 0.02).astype(np.uint8)
        out = []
        split(rgb.astype(int), mask, 0, 0, 32, out, 12)
        leaf = tiles.leaves(rgb, mask, 12)
        assert list(zip(leaf["x"], leaf["y"], leaf["w"])) == out  # depth first too


def test_tiles_keep_tolerance_and_area():
    rgb, mask = picture()
    leaf = tiles.leaves(rgb, mask, 12)
    t = tiles.merge(leaf, rgb, 12)
    assert (t["w"] * t["h"]).sum() == mask.size and t["merged_from"].sum() == len(leaf["x"]) and len(t["x"]) <= len(leaf["x"])
    for i in np.flatnonzero(~t["is_roi"]):
        x, y, w, h = (t[c][i] for c in "xywh")
        assert np.abs(rgb[y : y + h, x : x + w] - t["value"][i]).max() <= 12 + 1e-9


def runs(x, value, low, high, **options):
    n = len(x)
    one = np.ones(n, int)
    return tiles.merge_rows((np.zeros(n, int),), x, one, one, value, low, high, 12, **options)["n"].tolist()


def test_merge_rows_gap_cap_and_compat():
    n = 11
    x = np.arange(n)
    value = np.full((n, 3), 50.0)
    low, high = value.copy(), value.copy()
    low[5], high[5] = 0, 100
    assert runs(x, value, low, high) == [5, 1, 5]
    assert runs(x, value, low, high, compat=True) == [5] + [1] * 6
    assert runs(x, value, value, value, max_run=4) == [4, 4, 3]
    assert runs(np.where(x > 3, x + 1, x), value, value, value) == [4, 7]
    assert runs(x[:0], value[:0], low[:0], high[:0]) == []


def test_merge_rows_are_the_fewest_runs():
    """Against all cuts of small bands: the fewest runs, the last as short as can be, then the one before it."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        bands = [rng.integers(1, 9) for _ in range(3)]
        band = np.repeat(np.arange(3), bands)
        n = len(band)
        w = rng.integers(1, 4, n)
        x = np.concatenate([np.cumsum(w[band == b] + (rng.random(int(k)) < 0.15)) - w[band == b] for b, k in enumerate(bands)])
        value = np.repeat(rng.integers(0, 40, (n, 1)), 3, axis=1).astype(float)
        got = tiles.merge_rows((band,), x, w, np.ones(n, int), value, value, value, 12)["n"].tolist()
        want = []
        for b in range(3):
            i = np.flatnonzero(band == b)

            def fits(j, k, i=i):
                """Whether leaves j .. k - 1 make a tile, as do all that end with them."""
                for a in range(k - 2, j - 1, -1):
                    t = i[a:k]
                    mean = (value[t, 0] * w[t]).sum() / w[t].sum()
                    if x[i[a]] + w[i[a]] != x[i[a + 1]] or np.abs(value[t, 0] - mean).max() > 12:
                        return False
                return True

            best = {0: []}
            for k in range(1, len(i) + 1):
                best[k] = min(([*best[j], k - j] for j in range(k) if fits(j, k)), key=lambda r: (len(r), r[-1]))
            want += best[len(i)]
        assert got == want


def png(rgb, bits=8, kind=2):
    """A PNG file of a raster (height x width x channels)."""
    import struct
    import zlib

    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], bits, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_files_from_folder_to_verified_archive(spark, tmp_path):
    from tessera import cli
    from tessera.sources import images

    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    rgb = {"b.png": picture(40, 56, 1)[0], "sub/a.png": picture(33, 20, 2)[0]}
    for name, x in rgb.items():
        (folder / name).write_bytes(png(x))
    (folder / "gray.png").write_bytes(png(np.zeros((8, 8, 1), np.uint8), kind=0))
    (folder / "rgba.png").write_bytes(png(np.full((8, 8, 4), 200, np.uint8), kind=6))
    (folder / "deep.png").write_bytes(png(np.zeros((8, 8, 3), ">u2"), bits=16))
    (folder / "cut.png").write_bytes(png(rgb["b.png"])[:60])
    (folder / "bad.jpg").write_bytes(b"no image")
    (folder / "note.txt").write_bytes(b"text")
    rows = {r.path.rpartition("/in/")[2]: r for r in images.scan(spark, str(folder)).collect()}
    assert {k: r.reason for k, r in rows.items()} == {"b.png": None, "sub/a.png": None, "gray.png": "grayscale", "rgba.png": "not 3 channels", "deep.png": "not 8-bit", "cut.png": "not a decodable image", "bad.jpg": "not a decodable image"}
    assert all(rows[k].data == x.tobytes() and (rows[k].height, rows[k].width) == x.shape[:2] for k, x in rgb.items())  # colours in order
    out = str(tmp_path / "out.ascd")
    assert cli.main(["inspect", str(folder)], spark) == 0 and cli.main(["inspect", str(tmp_path / "nowhere")], spark) == 2
    assert cli.main(["compress", str(folder), "-o", out, "--roi-method", "classical", "-T", "10", "--batch-csv", str(tmp_path / "csv")], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["name", "roi_coverage", "final_cr", "total_time_s"]
    told = ["verify", "--original", str(folder), "--archive", out, "--roi-method", "classical"]
    assert cli.main([*told, "-T", "10", "--output-dir", str(tmp_path / "report")], spark) == 0
    assert spark.read.json(str(tmp_path / "report/verify_json/images")).count() == 2
    (folder / "sub/a.png").unlink()
    assert cli.main(told, spark) == 1  # an entry without an original
    (tmp_path / "other").write_bytes(b"NOPE")
    assert cli.main(["verify", "--original", str(folder), "--archive", str(tmp_path / "other")], spark) == 1


def test_masks_by_stem_and_fallback():
    from tessera.operators import roi

    rgb, mask = picture(40, 56, 1)
    half = (mask[::2, ::2] * 255).astype(np.uint8)
    found, meta = roi.segment(rgb, "mask-dir", user_mask=half)
    assert found.shape == mask.shape and meta["method"] == "mask-dir" and abs(found.mean() - mask.mean()) < 0.05
    with pytest.raises(ValueError):
        roi.segment(rgb, "mask-dir")
    for _ in range(2):
        found, meta = roi.segment(rgb, "u2net", model_path="/nowhere.onnx")
        assert meta["fallback"] and meta["method"] == "classical" and meta["fallback_reason"]
    assert roi._session.cache_info().hits >= 1  # the failure is kept


@pytest.mark.parametrize("data", [b"", b"a" * 200, b"ab" * 9, bytes(range(256)) * 4, np.random.default_rng(1).integers(0, 256, 5000, np.uint8).tobytes()])
def test_huffman_round_trip_and_size(data):
    body = codec.huffman_encode(data)
    assert codec.huffman_decode(body) == data
    kinds = len(set(data))
    if kinds == 1:
        assert len(body) == 4 + 12 + 1 + 2 + 4 + -(-len(data) // 8)


def test_codec_branches_and_errors():
    records = codec.serialize_tiles(np.array([[0, 0, 4, 4]] * 50), np.full((50, 3), 100.5), np.zeros(50, bool))
    assert codec.deserialize_tiles(records)["r"][0] == 100  # half to even
    met, meta = codec.encode_payload(records, 10_000, 4.0)
    assert not meta["huffman_used"] and len(codec.decode_payload(met)) == 50
    packed, meta = codec.encode_payload(records, 1000, 4.0)
    assert meta["huffman_used"] and (codec.decode_payload(packed) == codec.deserialize_tiles(records)).all()
    for bad in (b"NOPE" + b"\0" * 9, b"ASCE", b"ASCE\x07", b"ASCE\x00abc"):
        with pytest.raises(codec.CodecError):
            codec.decode_payload(bad)
    with pytest.raises(codec.CodecError):
        codec.serialize_tiles(np.array([[0, 0, 70000, 1]]), np.zeros((1, 3)), np.zeros(1, bool))


def test_imaging():
    ring = np.zeros((10, 10), np.uint8)
    ring[2:8, 2:8] = 1
    ring[4:6, 4:6] = 0
    assert imaging.fill_holes(ring)[2:8, 2:8].all() and imaging.fill_holes(ring).sum() == 36
    rgb, mask = picture(64, 64)
    s = imaging.spectral_saliency(rgb)
    assert s.shape == (64, 64) and 0 <= s.min() and s.max() <= 1
    assert not imaging.spectral_saliency(np.full((20, 30, 3), 100, np.uint8)).any()
    m = imaging.mask_stages(s, 90, 5)["dilate"]
    assert set(np.unique(m)) <= {0, 1} and m.any()
    assert imaging.network_input(rgb).shape == (1, 3, 320, 320)
    assert not imaging.network_output(np.full((1, 1, 2, 2), 3.0), 5, 6).any()
    with pytest.raises(imaging.SaliencyError):
        imaging.mask_stages(np.full((4, 4), np.nan))


def test_config():
    assert resolve_mode("fast") == "variance" and PipelineConfig().tolerance == 12
    for bad in ({"mode": "x"}, {"threshold": -1}, {"merge_tolerance": -1}, {"percentile": 101}, {"roi_method": "mask-dir"}):
        with pytest.raises(ConfigError):
            PipelineConfig(**bad)


@pytest.mark.parametrize("h, w", [(40, 50), (130, 70)])
def test_relational_leaves_equal_kernel(spark, h, w, monkeypatch):
    monkeypatch.setattr(quadtree, "HELD", 6 if h < 64 else 4)
    rgb, mask = picture(h, w, 3)
    rgb[: h // 2, : w // 2], mask[: h // 2, : w // 2] = 77, 0
    rows = [(1, y, x, *map(int, rgb[y, x]), int(mask[y, x])) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, roi int")
    for criterion in ("range", "variance"):
        got = {(r.x, r.y, r.w, r.h, r.is_roi, round(r.r, 6)) for r in quadtree.leaves(px, criterion, 12).collect()}
        leaf = tiles.leaves(rgb, mask, 12, criterion)
        assert got == {(int(x), int(y), int(w), int(h), bool(i), round(float(v[0]), 6)) for x, y, w, h, i, v in zip(*(leaf[c] for c in ("x", "y", "w", "h", "is_roi", "value")))}


def test_compress_archive_verify(spark, tmp_path):
    data = [(f"/in/p{i}.png", *picture(60 + i, 70, i)[0].shape[:2], picture(60 + i, 70, i)[0].tobytes()) for i in range(3)] + [("/in/bad.png", 5, 5, b"x")]
    images = spark.createDataFrame(data, "path string, height int, width int, data binary")
    results = compress.compress_images(images).persist()
    s = compress.batch_summary(results).first()
    assert (s.images, s.errors, s.roi_exact_rate) == (3, 1, 1.0)
    path = str(tmp_path / "a.ascd")
    assert archive.write(results, path) == 3
    index = archive.read(spark, path, payload=False).collect()
    assert [r.name for r in index] == ["p0.png", "p1.png", "p2.png"] and index[1].offset == index[0].length
    assert [r.name for r in archive.read(spark, path).filter("name = 'p1.png'").collect()] == ["p1.png"]
    rows = compress.verify_images(archive.read(spark, path), images).collect()
    assert {r.status for r in rows} == {"PASS"} and all(r.background_bound_ok for r in rows)
    (tmp_path / "bad").write_bytes(b"NOPE" + b"\0" * 20)
    with pytest.raises(archive.ArchiveError):
        archive.read_index(str(tmp_path / "bad"))


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["raster_summary"](spark, "/root/testdata/sf0.001").count() == 10


def test_hole_fill_and_leaf_order_of_every_image(spark):
    from tessera.plans import catalogue

    d = "/root/testdata/sf0.001"
    ids = [r.s_suppkey for r in spark.read.parquet(f"{d}/supplier.parquet").collect()]
    got = {r.image_id: (r.n_px, r.n_roi, r.n_filled) for r in catalogue.roi_hole_fill(spark, d).collect()}
    want = {}
    for i in ids:
        y, x = np.mgrid[: 48 + i % 17, :64]
        d2, rad = (x - 32) ** 2 + (y - 24) ** 2, 8 + i % 8
        ring = ((d2 >= rad**2) & (d2 <= (rad + 3) ** 2)).astype(np.uint8)
        out = (ring == 0) & ((y == 0) | (x == 0) | (y == y.max()) | (x == 63))
        while True:
            p = np.pad(out, 1)
            more = (ring == 0) & np.any([p[1 + b : 1 + b + out.shape[0], 1 + a : 65 + a] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
            if (more == out).all():
                break
            out = more
        want[i] = (ring.size, int(ring.sum()), int((~out).sum()))
    assert got == want and len({i % 10 for i in want}) == 10
    leaves = catalogue.quadtree_leaves_range(spark, d).groupBy("image_id").sum("n_leaves").collect()
    order = catalogue.quadtree_morton_order(spark, d).collect()
    of = {i: sorted((r.place, r.code, r.x, r.y) for r in order if r.image_id == i) for i in ids}
    assert {i: len(v) for i, v in of.items()} == {r.image_id: r[1] for r in leaves}
    for rows in of.values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1] for r in rows] == sorted({r[1] for r in rows})
        assert all(code == sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(6)) for _, code, x, y in rows)


def test_byte_histogram_counts_every_byte(spark, tmp_path):
    from collections import Counter

    from tessera.plans import catalogue

    texts = ["é漢字😀 ß", "a\0b\x7f", "", None, "plain\n" * 300]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.byte: r.n for r in catalogue.byte_histogram(spark, str(tmp_path)).collect()} == Counter(b"".join((t or "").encode() for t in texts))


#: Queries over pixels, none of which may be broadcast: Spark takes them for as few as the suppliers they are made of.
OVER_PIXELS = ["raster_pad", "roi_percentile_threshold", "quadtree_leaves_range", "block_range_pyramid", "block_stats_pyramid", "verify_pixel_compare", "row_bands", "dp_row_merge", "quadtree_reconstruct_error", "vertical_merge", "band_islands", "dp_backtrack_tiles", "mode_switch_compare", "quadtree_leaves_variance", "quadtree_morton_order", "tile_area_weighted_mean", "tile_reduction_ratio", "tile_wire_size", "tiles_paint_range_join", "tall_quadtree_leaves", "verify_summary", "vertical_stacks"]


@pytest.mark.parametrize("name", OVER_PIXELS)
def test_no_pixels_are_broadcast(spark, name):
    from tessera.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan


def _entries(spark, n):
    """n entries of some partitions, more than a range exchange takes whole to draw its bounds."""
    from pyspark.sql import functions as F

    return spark.range(0, n, 1, 3).select("id", F.concat(F.lit("e"), "id").alias("name"), (1 + F.col("id") * 37 % 900).alias("length"), F.lit(4).alias("width"), F.lit(4).alias("height"))


def test_offsets_of_many_entries(spark):
    from tessera.operators import verify

    rows = sorted(verify.offsets(_entries(spark, 40_000), "id").select("id", "name", "length", "offset").collect())
    assert len(rows) == 40_000
    at = 0
    for r in rows:
        assert r.offset == at
        at += r.length


def test_overlaps_of_many_entries(spark):
    from pyspark.sql import functions as F

    from tessera.operators import verify

    whole = _entries(spark, 40_000).withColumn("length", F.lit(10)).withColumn("offset", F.col("id") * 10)
    assert verify.structure_errors(whole).collect() == []
    moved = whole.withColumn("offset", F.col("offset") - F.when(F.col("id") % 1000 == 4, 3).otherwise(0))
    found = {(r.name, r.problem) for r in verify.structure_errors(moved).collect()}
    assert found == {x for i in range(4, 40_000, 1000) for x in ((f"e{i}", "overlaps an entry before"), (f"e{i + 1}", "gap before the entry"))}

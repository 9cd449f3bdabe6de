"""Command line: inspect a folder, compress it to an archive, or verify an archive. Exit codes: 0 done, 1 nothing valid or not verified, 2 bad arguments."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import MODES, ROI_METHODS, ConfigError, PipelineConfig
from .operators import compress as K
from .operators import diagnose, verify
from .sources import archive, images


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--version", action="version", version=f"tessera {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("inspect", help="count and size the images of a folder")
    c = sub.add_parser("compress", help="compress a folder of images to an archive")
    v = sub.add_parser("verify", help="compare an archive with the images it was made from")
    for s in (i, c):
        s.add_argument("dataset")
    v.add_argument("--original", required=True, dest="dataset")
    v.add_argument("--archive", required=True)
    v.add_argument("--output-dir", help="folder of the CSV and JSON reports")
    for s in (i, c, v):
        s.add_argument("--no-recursive", action="store_true")
        s.add_argument("--log-file")
        s.add_argument("-v", "--verbose", action="store_true")
    for s in (c, v):
        s.add_argument("-T", "--threshold", type=float, default=12.0)
        s.add_argument("--mode", choices=MODES, default="strict")
        s.add_argument("--roi-method", choices=ROI_METHODS, default="u2net")
        s.add_argument("--model-path")
        s.add_argument("--mask-dir")
        s.add_argument("--percentile", type=float, default=90.0)
        s.add_argument("--dilate-px", type=int, default=5)
    c.add_argument("-o", "--output", default="dataset.ascd")
    c.add_argument("--target-cr", type=float, default=4.0)
    c.add_argument("--merge-tolerance", type=float)
    c.add_argument("--batch-csv", help="folder of the batch report")
    return p


def _log(args) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()] + ([logging.FileHandler(args.log_file, encoding="utf-8")] if args.log_file else [])
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, handlers=handlers, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)


def _masks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("image").load(folder).select("image.origin", "image.height", "image.width", "image.data").toDF("path", "height", "width", "data")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = build_parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    _log(args)
    if not os.path.exists(args.dataset):
        logging.error("no such path: %s", args.dataset)
        return 2
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    scanned = images.scan(spark, args.dataset, not args.no_recursive)
    if args.command == "inspect":
        r = images.inspect(scanned).first()
        print(f"{r['valid']} valid, {r['rejected']} rejected, {r['raw_bytes']} raw bytes, {r['disk_bytes']} bytes on disk")
        for x in scanned.filter("reason is not null").select("path", "reason").toLocalIterator():
            logging.warning("%s: %s", x["path"], x["reason"])
        return 0 if r["valid"] else 1
    try:
        shared = {"mode": args.mode, "threshold": args.threshold, "roi_method": args.roi_method, "model_path": args.model_path, "mask_dir": args.mask_dir, "percentile": args.percentile, "dilate_px": args.dilate_px}
        config = PipelineConfig(**shared, **({"target_cr": args.target_cr, "merge_tolerance": args.merge_tolerance} if args.command == "compress" else {}))
    except ConfigError as e:
        logging.error("%s", e)
        return 2
    valid = scanned.filter("reason is null")
    if args.mask_dir:
        valid = images.with_masks(valid, _masks(spark, args.mask_dir))
    return _compress(valid, config, args) if args.command == "compress" else _verify(spark, valid, config, args)


def _compress(valid: DataFrame, config: PipelineConfig, args) -> int:
    results = K.compress_images(valid, config).persist()
    try:
        n = archive.write(results, args.output)
        s = K.batch_summary(results).first()
        for r in results.filter("error is not null").select("name", "error").toLocalIterator():
            logging.warning("%s: %s", r["name"], r["error"])
        if args.batch_csv:
            diagnose.write_batch_csv(results, args.batch_csv)
        print(f"{n} images, {s['errors']} errors, mean compression ratio {s['mean_cr']:.3f}, ROI exact {s['roi_exact_rate']:.1%}")
    finally:
        results.unpersist()
    return 0 if n else 1


def _verify(spark: SparkSession, valid: DataFrame, config: PipelineConfig, args) -> int:
    try:
        entries = archive.read(spark, args.archive)
        index = archive.read(spark, args.archive, payload=False)
        damaged = verify.structure_errors(index).collect()
    except Exception as e:  # noqa: BLE001  whatever the reader raises means that there is no archive to verify
        logging.error("the archive can't be read: %s", str(e).splitlines()[0])
        return 1
    names = valid.select(images.basename(F.col("path")).alias("name"))
    lost = {"missing from the archive": verify.missing(names, index), "without an original": verify.extra(names, index), "originals of one name": verify.duplicates(names)}
    lost = {what: [r["name"] for r in rows.select("name").collect()] for what, rows in lost.items()}
    rows = diagnose.progress(K.verify_images(entries, valid, config), "image").persist()
    try:
        s = verify.summary(rows).first()
        for r in damaged:
            logging.error("%s: %s", r["name"], r["problem"])
        for what, found in lost.items():
            for name in found:
                logging.error("%s: %s", what, name)
        for r in rows.filter("status <> 'PASS'").select("image", "reason").toLocalIterator():
            logging.error("%s: %s", r["image"], r["reason"])
        if args.output_dir:
            verify.write_reports(rows, args.output_dir)
    finally:
        rows.unpersist()
    passed = bool(s["verdict"]) and s["images"] > 0 and not damaged and not any(lost.values())
    print(f"{s['passed']} of {s['images']} images pass, {s['roi_exact_percent']:.3f} % of the ROI pixels are exact, worst background error {s['max_background_error']}: {'PASS' if passed else 'FAIL'}")
    return 0 if passed else 1

"""Command line: split a dataset by resolution, plan tiles, sort images by size, sample frames.

Exit codes: 0 done, 1 a wrong configuration or any other error, 2 sampling beyond a video's end, 3 nothing written.
"""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from annogrid.operators import frames, tiles
from annogrid.sources import coco, files


class Beyond(ValueError):
    """Sampling that goes on after a video's end."""


def split(spark: SparkSession, settings: dict) -> int:
    """Write a folder of annotations for each resolution."""
    data = coco.read(spark, settings["coco_json_path"])
    coco.write_parts(data["images"], data["annotations"].drop("extra"), settings["output_dir"])
    return 0


def preprocess(spark: SparkSession, settings: dict) -> int:
    """Write the tiles of each resolution."""
    images = coco.read(spark, settings["coco_json_path"])["images"]
    ratios = tiles.overlap_ratios(images.select("width", "height").distinct(), settings["tile_width"], settings["tile_height"])
    tiles.tiles(ratios).write.mode("overwrite").option("header", True).csv(settings["output_dir"])
    return 0


def sort_images(spark: SparkSession, settings: dict) -> int:
    """Move images into folders by size; a destination that is there already is left alone. The plan is a table, the moves are the driver's."""
    plan = files.planned_moves(files.image_sizes(files.list_images(spark, settings["images"])), settings["images"]).where("moves")
    moved = 0
    for row in plan.toLocalIterator():
        source, target = (Path(p.removeprefix("file:")) for p in (row.source, row.destination))
        if not target.exists():
            target.parent.mkdir(parents=True, exist_ok=True)
            shutil.move(source, target)
            moved += 1
    return 0 if moved else 3


def sample(spark: SparkSession, settings: dict) -> int:
    """Sample a frame table (video, ts, frame columns in Parquet)."""
    rows, s = spark.read.parquet(settings["frames"]), settings.get("sample", {})
    offset, duration = float(s.get("offset_seconds", 0)), s.get("duration_seconds")
    if duration is not None and frames.check_window(rows, "video", "ts", offset, float(duration)).limit(1).count():
        raise Beyond("a video ends before the stretch that is asked for")
    out = frames.sampled(rows, "video", "ts", ["ts"], int(settings.get("every", 1)), offset, None if duration is None else float(duration))
    frames.chunked(out, int(settings.get("chunk_size", 1000))).write.mode("overwrite").parquet(settings["output_dir"])
    return 0 if spark.read.parquet(settings["output_dir"]).limit(1).count() else 3


COMMANDS = {"split": split, "preprocess": preprocess, "sort-images": sort_images, "sample": sample}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config", type=Path)
    parser.add_argument("command", choices=COMMANDS)
    named = parser.parse_args(args)
    try:
        settings = yaml.safe_load(named.config.read_text())
        spark = SparkSession.builder.appName(f"annogrid {named.command}").getOrCreate()
        return COMMANDS[named.command](spark, settings)
    except Beyond as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

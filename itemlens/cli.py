"""Command line: train once, then browse / trending / top / recommend.

    python -m itemlens train --out DIR (--sf-dir DIR | --catalog-csv PATH --interactions PATH)
    python -m itemlens browse --out DIR [--category C] [--area A] [--level L]
                              [--min-rating R] [--sort-by rating|popularity|reviews|price] [--limit N]
    python -m itemlens trending --out DIR
    python -m itemlens top --out DIR [--limit N]
    python -m itemlens recommend --out DIR --users 1,2,3 [--top-n N]

``train`` writes the prepared catalogue, the ratings, the ALS model, the ranked top list,
the user key map (with 64-bit keys) and a metrics file as one version under
``--out`` (use a shared folder on a cluster).  Ids come from registries beside the
versions: every key keeps its id, also one that left and returns.  A run that was ended
goes on, with the same arguments, after its last finished stage.
The other commands read the last finished version and print JSON lines; every
result they print is bounded by its validated limit.
"""

from __future__ import annotations

import argparse
import json
import sys

from itemlens.functions import rules as R


def _paths(base: str) -> dict[str, str]:
    base = base.rstrip("/")
    return {name: f"{base}/{name}" for name in ("catalog", "ratings", "model", "top_list", "metrics", "user_map")}


def _exists(spark, path: str) -> bool:
    from itemlens.session import hadoop_path

    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def _versions(spark, out: str) -> list[str]:
    """Finished versions under ``out``, oldest first.

    A version is a folder that ``train`` fills and then marks as finished by an
    empty file, so a reader never sees artefacts of two runs together.
    """
    from itemlens.session import hadoop_path

    p, fs = hadoop_path(spark, out)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = sorted(n for n in names if n.startswith("version-") and _exists(spark, f"{out}/{n}/FINISHED"))
    return [f"{out}/{n}" for n in done]


def _current(spark, args) -> dict[str, str]:
    found = _versions(spark, args.out.rstrip("/"))
    if not found:
        raise FileNotFoundError(f"no trained artefacts under {args.out}")
    return _paths(found[-1])


def _print_rows(df) -> None:
    for row in df.collect():
        print(json.dumps(row.asDict(recursive=True), default=str))


def _rules(args):
    if args.sf_dir:
        from itemlens.sources.tables import PART_RULES

        return PART_RULES
    return R.SERVING_RULES if args.serving_labels else R.ARTEFACT_RULES


def cmd_train(spark, args) -> None:
    from itemlens.operators.id_registry import IdRegistry
    from itemlens.plans.catalog import id_map
    from itemlens.plans.stages import StageLog, fingerprint
    from itemlens.plans.train import TrainConfig, train
    from itemlens.session import hadoop_path
    from itemlens.sources import io as IO
    from itemlens.sources import tables as TB

    out = args.out.rstrip("/")
    earlier = _versions(spark, out)
    if args.sf_dir:
        raw = TB.load_catalog(spark, args.sf_dir)
        interactions = TB.load_interactions(spark, args.sf_dir, wide_user_keys=args.wide_user_keys)
    else:
        if not (args.catalog_csv and args.interactions):
            raise SystemExit("train needs --sf-dir, or --catalog-csv and --interactions")
        raw = IO.read_catalog_csv(spark, args.catalog_csv)
        interactions = IO.guarded_read(spark.read.parquet, args.interactions, "interactions")
    rules = _rules(args)
    config = TrainConfig(
        rank=args.rank,
        max_iter=args.max_iter,
        reg_param=args.reg_param,
        seed=args.seed,
        holdout_user_fraction=args.holdout_users,
        ratings_per_user=tuple(args.ratings_per_user) if args.ratings_per_user else None,
    )
    last = int(earlier[-1].rsplit("-", 1)[1]) if earlier else 0
    version = f"{out}/version-{last + 1:08d}"
    p = _paths(version)
    log = StageLog(spark, version, fingerprint(config, rules, args.sf_dir, args.catalog_csv, args.interactions, args.wide_user_keys))

    # Ids come from registries that keep the keys of all versions, also of those that left.
    old = _paths(earlier[-1]) if earlier else None
    items = IdRegistry(spark, f"{out}/registry/items", "item_key", "item_id")
    if old is not None and not items.versions():
        items.seed(id_map(spark.read.parquet(old["catalog"])))
    ids = users = None
    if log.facts("catalog") is None:
        ids = items.register(raw.select("item_key"))
    if "user_key" in interactions.columns and log.facts("user_map") is None:
        keys = IdRegistry(spark, f"{out}/registry/users", "user_key", "user_id", interactions.schema["user_key"].dataType)
        if old is not None and not keys.versions() and _exists(spark, old["user_map"]):
            keys.seed(spark.read.parquet(old["user_map"]))
        users = keys.register(interactions.select("user_key").where("user_key is not null")).drop("since")
    result = train(
        spark,
        raw,
        interactions,
        rules,
        config,
        existing_ids=ids,
        existing_users=users,
        log=log,
        **{f"{name}_path": path for name, path in p.items()},
    )
    mark, fs = hadoop_path(spark, f"{version}/FINISHED")
    fs.create(mark, True).close()
    _print_rows(result.metrics)


def _catalog(spark, args):
    from itemlens.sources.io import guarded_read

    return guarded_read(spark.read.parquet, _current(spark, args)["catalog"], "prepared catalogue")


def cmd_browse(spark, args) -> None:
    from itemlens.plans.browse import browse, browse_total

    rules = _rules(args)
    cat = _catalog(spark, args)
    kw = dict(category=args.category, area=args.area, level=args.level, min_rating=args.min_rating)
    page = browse(
        cat,
        sort_by=args.sort_by,
        limit=args.limit,
        level_labels=rules.level_labels,
        default_category=rules.default_category,
        default_area=rules.area.default,
        **kw,
    )
    _print_rows(page.orderBy("rank"))
    _print_rows(browse_total(cat, **kw))


def cmd_trending(spark, args) -> None:
    from itemlens.plans.trending import busiest_areas, trending_categories

    rules = _rules(args)
    cat = _catalog(spark, args)
    _print_rows(trending_categories(cat, R.TRENDING_K, rules.default_category).orderBy("rank"))
    _print_rows(busiest_areas(cat, R.TRENDING_K).orderBy("rank"))


def cmd_top(spark, args) -> None:
    from itemlens.operators.predicates import check_int_range
    from itemlens.sources.io import read_top_list

    check_int_range("limit", args.limit, 1, R.TOP_LIST_READ_MAX)
    _print_rows(read_top_list(spark, _current(spark, args)["top_list"], limit=args.limit).orderBy("rank"))


def cmd_recommend(spark, args) -> None:
    from pyspark.sql import functions as F

    from itemlens.plans.recommend import recommend
    from itemlens.sources.io import load_model

    rules = _rules(args)
    ids = [int(x) for x in args.users.split(",") if x.strip()]
    p = _current(spark, args)
    asked = spark.createDataFrame([(i,) for i in ids], "asked long").distinct()
    if _exists(spark, p["user_map"]):
        # The model knows users by their dense ids; they are asked for, and
        # answered, by the keys that they were trained from.
        known = spark.read.parquet(p["user_map"]).select(F.col("user_key").cast("long").alias("asked"), "user_id")
        asked = asked.join(known, "asked", "left")
    else:
        asked = asked.withColumn("user_id", F.col("asked").try_cast("int"))
    model = load_model(p["model"])
    recs = recommend(asked, model, _catalog(spark, args), args.top_n, rules.default_category, rules.area.default)
    recs = recs.withColumnRenamed("user_id", "known")
    out = asked.join(recs, F.col("user_id").eqNullSafe(F.col("known"))).drop("user_id", "known")
    _print_rows(out.withColumnRenamed("asked", "user_id").orderBy("user_id", "rank"))


def build_parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="itemlens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    ap.add_argument("--shuffle-partitions", type=int, default=None, help="default: from the environment")
    sub = ap.add_subparsers(dest="cmd", required=True)

    def common(p):
        p.add_argument("--out", required=True, help="folder with the trained artefacts")
        p.add_argument("--sf-dir", default=None, help="driver test tables (selects their rule set)")
        p.add_argument("--serving-labels", action="store_true", help="substring / lpad2 / serving vocabulary")

    t = sub.add_parser("train")
    common(t)
    t.add_argument("--catalog-csv")
    t.add_argument("--interactions", help="parquet with user_id (or user_key), item_key, value")
    t.add_argument("--wide-user-keys", action="store_true")
    t.add_argument("--rank", type=int, default=R.ALS_RANK)
    t.add_argument("--max-iter", type=int, default=R.ALS_MAX_ITER)
    t.add_argument("--reg-param", type=float, default=R.ALS_REG_PARAM)
    t.add_argument("--seed", type=int, default=R.SEED)
    t.add_argument("--holdout-users", type=float, default=0.0)
    t.add_argument("--ratings-per-user", type=int, nargs=2, default=None)

    b = sub.add_parser("browse")
    common(b)
    b.add_argument("--category")
    b.add_argument("--area")
    b.add_argument("--level")
    b.add_argument("--min-rating", type=float)
    b.add_argument("--sort-by", default="rating")
    b.add_argument("--limit", type=int, default=R.BROWSE_DEFAULT_LIMIT)

    common(sub.add_parser("trending"))

    tp = sub.add_parser("top")
    common(tp)
    tp.add_argument("--limit", type=int, default=R.TOP_LIST_READ_DEFAULT)

    r = sub.add_parser("recommend")
    common(r)
    r.add_argument("--users", required=True, help="comma-separated user ids")
    r.add_argument("--top-n", type=int, default=R.RECOMMEND_DEFAULT_N)
    return ap


COMMANDS = {
    "train": cmd_train,
    "browse": cmd_browse,
    "trending": cmd_trending,
    "top": cmd_top,
    "recommend": cmd_recommend,
}


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from itemlens.session import build_session, clear_scratch, ensure_checkpoint_dir

    existing = SparkSession.getActiveSession()
    # Neither master nor shuffle partitions unless asked for: spark-submit decides.
    spark = existing or build_session(args.master, args.shuffle_partitions)
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{args.out.rstrip('/')}/_scratch")
    ensure_checkpoint_dir(spark)
    try:
        COMMANDS[args.cmd](spark, args)
    except (ValueError, FileNotFoundError) as exc:
        print(f"error: {exc}", file=sys.stderr)
        return 2
    finally:
        if existing is None:
            clear_scratch(spark)
            spark.stop()
    return 0

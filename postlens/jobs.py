"""Command-line jobs, runnable with ``spark-submit`` or ``python -m postlens``.

    train     --corpus CSV --model DIR [--holdout N]
    validate  --corpus CSV --model DIR [--out DIR]
    analyze   --posts PATH --analysis NAME [--analysis NAME ...] --out DIR [--model DIR] [--chart]
              [--no-jitter] [--seed N] [--langs [..]] [--publish]
    capture   --landing DIR --sink DIR --checkpoint DIR [--langs [..]] [--words [..] | --words-file FILE]
              [--continuous] [--count N --out DIR] [--batches [--stop-at N]]

train, validate and analyze take --stop-words FILE. Intermediate tables go to
--scratch, or the folder named in spark.checkpoint.dir, and are removed.

Paths may be on any Hadoop-compatible file system. Nothing row-level is
collected to the driver; results are written by the executors.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark import StorageLevel

from postlens.operators import classifier as C
from postlens.plans import dispatch
from postlens.session import get_session, remove_path, scratch_path
from postlens.sinks import publish, write_accuracy, write_result
from postlens.sources.posts import posts_to_json, read_posts
from postlens.sources.stopwords import STOP_WORDS, read_stop_words
from postlens.sources.training import read_training_csv
from postlens.streaming import batches as B
from postlens.streaming import capture as K


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="postlens", description=__doc__.split("\n\n")[0])
    p.add_argument("--master", default=None, help="only for local runs; leave unset under spark-submit")
    p.add_argument("--scratch", default=None, help="shared folder for intermediate tables")
    sub = p.add_subparsers(dest="cmd", required=True)

    t = sub.add_parser("train", help="train the sentiment classifier on a labelled CSV corpus")
    t.add_argument("--corpus", required=True)
    t.add_argument("--model", required=True)
    t.add_argument("--holdout", type=int, default=0,
                   help="hold out N of 10 hash buckets of the text and print accuracy on them")

    v = sub.add_parser("validate", help="accuracy of a saved classifier on a labelled corpus")
    v.add_argument("--corpus", required=True)
    v.add_argument("--model", required=True)
    v.add_argument("--out", default=None, help="append validation rows (tsv.gz) here")

    a = sub.add_parser("analyze", help="run one or more analyses over JSON-lines posts")
    a.add_argument("--posts", required=True)
    a.add_argument("--analysis", required=True, action="append",
                   help="analysis name, e.g. 'Top 5 Word Count Hashtags'; repeat for several "
                        "(then each result goes to OUT/<analysis key>)")
    a.add_argument("--out", required=True)
    a.add_argument("--model", default=None, help="saved classifier (sentiment analyses)")
    a.add_argument("--chart", action="store_true", help="write the chart data instead of the rows")
    a.add_argument("--format", default="csv")
    a.add_argument("--no-jitter", action="store_true", help="plain labels in the sentiment pie and timeline")
    a.add_argument("--publish", action="store_true",
                   help="put the result in force by one atomic switch; readers use sinks.read_published")
    a.add_argument("--seed", type=int, default=0, help="seed of the label draw")
    a.add_argument("--langs", default=None, help="only these languages in the sentiment pie and timeline")

    c = sub.add_parser("capture", help="capture posts from a landing directory")
    c.add_argument("--landing", required=True)
    c.add_argument("--sink", required=True)
    c.add_argument("--checkpoint", required=True)
    c.add_argument("--langs", default="[" + ",".join(K.DEFAULT_LANGS) + "]")
    c.add_argument("--words", default="[" + ",".join(K.DEFAULT_WORDS) + "]")
    c.add_argument("--continuous", action="store_true", help="keep running instead of availableNow")
    c.add_argument("--count", default=None, help="write the first N captured posts, by time and id, to --out")
    c.add_argument("--out", default=None)
    c.add_argument("--batches", action="store_true",
                   help="write batches by language and day, with a ledger, control records and broken lines")
    c.add_argument("--stop-at", default=None, help="end the capture once N posts are captured (with --batches)")
    c.add_argument("--words-file", default=None, help="a file of tracked words, one per line, of any length (with --batches)")
    for parser in (t, v, a):
        parser.add_argument("--stop-words", default=None, help="a file of stop words, one per line, instead of the fixed list")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.cmd == "capture" and args.count is not None and (args.continuous or not args.out):
        raise SystemExit("--count needs --out, and an end: not --continuous")
    if args.cmd == "capture" and not args.batches and (args.stop_at is not None or args.words_file):
        raise SystemExit("--stop-at and --words-file need --batches")
    if args.cmd == "capture" and args.batches and args.count is not None:
        raise SystemExit("--batches stops with --stop-at, not with --count")
    spark = get_session(master=args.master, app=f"postlens-{args.cmd}")
    stop_words = read_stop_words(spark, args.stop_words) if getattr(args, "stop_words", None) else STOP_WORDS

    if args.cmd == "train":
        corpus = read_training_csv(spark, args.corpus)
        if args.holdout:
            fit_on, held_out = C.holdout_split(corpus, key="status", test_buckets=args.holdout)
            model = C.train(fit_on, stop_words=stop_words)
            acc = C.accuracy(C.predictions(held_out, model, stop_words=stop_words)).first()  # one row
            print(json.dumps({"holdout": acc.asDict()}))
        else:
            model = C.train(corpus, stop_words=stop_words)
        C.save(model, args.model)
    elif args.cmd == "validate":
        preds = C.predictions(read_training_csv(spark, args.corpus), C.load(args.model), stop_words=stop_words)
        if args.out:  # used twice: keep the scored rows (recomputable if lost)
            preds = preds.persist(StorageLevel.MEMORY_AND_DISK)
        acc = C.accuracy(preds).first()  # one row
        print(json.dumps(acc.asDict()))
        if args.out:
            write_accuracy(preds, args.out)
            preds.unpersist()
    elif args.cmd == "analyze":
        model = C.load(args.model) if args.model else None
        scored_path = scratch_path(spark, "scored", folder=args.scratch)
        chosen = {"jitter": not args.no_jitter, "seed": args.seed, "langs": K.parse_list_arg(args.langs) if args.langs else None}
        results = dispatch.run_many(
            args.analysis, read_posts(spark, args.posts), model=model, scored_path=scored_path,
            options={k: chosen for k in ("sentiment_counts", "sentiment_timeline")}, stop_words=stop_words,
        )
        for key, result in results.items():
            if args.chart:
                result = dispatch.chart(key, result)
            bounded = args.chart and key in dispatch.BOUNDED_CHARTS
            out = args.out if len(results) == 1 else f"{args.out.rstrip('/')}/{key}"
            if args.publish:
                publish(result.coalesce(1) if bounded else result, out, args.format, **({"header": True} if args.format == "csv" else {}))
            else:
                write_result(result, out, fmt=args.format, single_file=bounded)
        remove_path(spark, scored_path)
    elif args.cmd == "capture":
        langs, words = K.parse_list_arg(args.langs), K.parse_list_arg(args.words)
        if args.batches:
            tracked = read_stop_words(spark, args.words_file) if args.words_file else words
            n = None if args.stop_at is None else K.parse_count_arg(args.stop_at)
            if n is None or B.captured_so_far(spark, args.sink) < n:
                B.start_batches(
                    spark, args.landing, args.sink, args.checkpoint, langs, tracked, n, available_now=not args.continuous
                ).awaitTermination()
            return 0
        q = K.start_capture(
            spark, args.landing, args.sink, args.checkpoint, langs, words,
            available_now=not args.continuous,
        )
        q.awaitTermination()
        if args.count is not None:
            first = K.read_captured(spark, args.sink, K.parse_count_arg(args.count))
            posts_to_json(first).write.mode("overwrite").text(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

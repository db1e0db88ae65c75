"""python -m tidelog COMMAND: demo, policies, queries, run, transcribe, endpoints, bench, wer. Exit 0 fine, 1 failed, 2
wrong usage."""

from __future__ import annotations

import argparse
import sys

from .policy import PRESETS, policy


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidelog").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidelog")
    sub = p.add_subparsers(dest="command", required=True)
    demo = sub.add_parser("demo", help="two scripted voices through a session")
    demo.add_argument("--policy", default="conversation")
    sub.add_parser("policies", help="the presets")
    sub.add_parser("queries", help="names of the registered queries")
    run = sub.add_parser("run", help="write a query's rows as Parquet, or show some")
    run.add_argument("name")
    run.add_argument("data")
    run.add_argument("--out")
    transcribe = sub.add_parser("transcribe", help="a table of chunk rows, or a folder of recordings, to JSON lines")
    transcribe.add_argument("source")
    transcribe.add_argument("out")
    transcribe.add_argument("--policy", default="conversation")
    transcribe.add_argument("--audio", action="store_true", help="source is a folder of recordings")
    transcribe.add_argument("--words", help="a table of what a recogniser said: session, chunk_no, words, tentative, fragment")
    endpoints = sub.add_parser("endpoints", help="how a turn detector does on an index of whole and cut clips")
    endpoints.add_argument("folder")
    endpoints.add_argument("--index", default="index")
    bench = sub.add_parser("bench", help="speakers of recordings (FOLDER/audio) against true turns (FOLDER/truth)")
    bench.add_argument("folder")
    bench.add_argument("--words", required=True, help="a table of what a recogniser said")
    bench.add_argument("--policy", default="conversation")
    wer = sub.add_parser("wer", help="word errors of a table with reference and hypothesis, or of two folders of transcripts")
    wer.add_argument("paths", nargs="+")
    return p


def _log(args, folder: str):
    """The log of a folder of recordings, and the sessions' names."""
    from .plans.audio import audio_log, recorded_frames
    from .sources.recordings import read_recordings

    spark = _spark()
    frames = recorded_frames(read_recordings(spark, folder), spark.read.parquet(args.words) if args.words else None)
    return audio_log(frames, policy(args.policy)), frames.select("session", "session_id").distinct()


def transcribe(args) -> None:
    from .operators.protocol import encode
    from .plans.runner import run_batch
    from .schema import CHUNK

    if args.audio:
        log, names = _log(args, args.source)
        lines = encode(log, "seq").join(names, "session_id").select("session", "seq", "line")
    else:
        chosen = policy(args.policy)
        lines = encode(run_batch(_spark().read.schema(CHUNK).parquet(args.source), chosen), "seq").withColumnRenamed("session_id", "session")
    lines.repartition("session").sortWithinPartitions("session", "seq").drop("seq").write.mode("overwrite").partitionBy("session").text(args.out)


def bench(args) -> None:
    from pyspark.sql import functions as F

    from .operators.score import log_report
    from .sources.files import read_truth_turns

    log, names = _log(args, f"{args.folder}/audio")
    turns = read_truth_turns(_spark(), f"{args.folder}/truth").withColumn("session", F.regexp_extract("path", r"session_id=([^/]+)", 1))
    report = log_report(log, turns.join(names, "session").drop("session", "path"))
    print(report.join(names, "session_id").drop("session_id").orderBy("session").toPandas().to_string(index=False))


def word_errors(paths: list[str]) -> None:
    from pyspark.sql import functions as F

    from .operators.score import corpus_errors
    from .sources.files import read_transcripts

    if len(paths) == 1:
        pairs = _spark().read.parquet(paths[0])
    else:
        true, said = (read_transcripts(_spark(), p) for p in paths[:2])
        pairs = true.withColumnRenamed("text", "reference").join(said.select("key", F.col("text").alias("hypothesis")), "key")
    print(corpus_errors(pairs).toPandas().to_string(index=False))


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if args.command == "policies":
            for name, p in PRESETS.items():
                print(f"{name:<14} {'one speaker' if p.solo else 'speakers':<12} silence {p.endpoint.silence} s, completeness {p.endpoint.threshold}, timeout {p.endpoint.timeout} s")
        elif args.command == "demo":
            from .streaming.models import demo

            for e in demo(policy(args.policy)):
                print(f"{e['seq']:>3}  {e['at']:6.2f} s  {e['kind']:<12}  {e.get('text') or e.get('reason') or e.get('speaker') or ''}")
        elif args.command == "queries":
            from .plans import registry

            print("\n".join(sorted(registry.QUERIES)))
        elif args.command == "run":
            from .plans import registry

            if args.name not in registry.QUERIES:
                print(f"no query {args.name!r}", file=sys.stderr)
                return 2
            df = registry.QUERIES[args.name](_spark(), args.data)
            df.write.mode("overwrite").parquet(args.out) if args.out else df.show(20, False)
        elif args.command == "transcribe":
            transcribe(args)
        elif args.command == "endpoints":
            from .policy import policies
            from .sources.fixtures import gate_report
            from .streaming.models import SilenceTurns

            spark = _spark()
            print(gate_report(spark, args.folder, "silence", SilenceTurns, policies(spark), args.index).orderBy("policy").toPandas().to_string(index=False))
        elif args.command == "bench":
            bench(args)
        else:
            word_errors(args.paths)
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001  a command says what failed
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: python -m passagemill.cli [--retrieve] [--database-info] question..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from passagemill import options
from passagemill.plans import retrieve as R
from passagemill.sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="passagemill", description="Ask the stored passages.")
    p.add_argument("--database-info", action="store_true", help="print the table's path and rows")
    p.add_argument("--retrieve", action="store_true", help="print the kept passages, without an answer")
    p.add_argument("--allow-downloads", action="store_true", help="let providers fetch models")
    p.add_argument("--serve", type=int, metavar="PORT", help="answer over HTTP")
    p.add_argument("--shell", action="store_true", help="ask line by line; /raw QUESTION shows scores, /exit ends")
    p.add_argument("question", nargs="*")
    return p


def _session() -> SparkSession:
    return SparkSession.builder.appName("passagemill").getOrCreate()


def ask(spark: SparkSession, path: str, question: str, retrieve_only: bool = False) -> dict | list:
    """The result of one question, which is a DataFrame of one row to the plan."""
    chunks = store.with_places(store.open_table(spark, path))
    q = spark.createDataFrame([(1, question)], "qid int, question string")
    detail = R.retrieve(q, chunks, vectors=chunks.select("id", "vector"), index=store.open_index(spark, path))
    if retrieve_only:
        return [r.asDict() for r in detail.kept.orderBy("kept_rank").select("id", "chapter", "order", "score", "text").collect()]
    return json.loads(R.answers(q, detail.kept).select(F.to_json(F.struct("found", "answer", "sources", "message"))).first()[0])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    o = options.configure(allow_model_downloads=a.allow_downloads)
    spark = _session()
    if a.database_info:
        info = store.info(spark, o.database_path)
        print(f"database: {info['path']}\nrows: {info['rows']}")
        return 0
    if a.serve is not None:
        from passagemill.server import serve

        serve(lambda q: ask(spark, o.database_path, q), a.serve).serve_forever()
    if a.shell:
        for line in map(str.strip, sys.stdin):
            if line == "/exit":
                break
            if line.startswith("/raw "):
                for k in ask(spark, o.database_path, line[5:], True):
                    print(f"{k['score']:.2f} {k['chapter']}")
            elif line:
                r = ask(spark, o.database_path, line)
                print(r.get("answer") or r.get("message"), "; ".join(s["chapter"] for s in r.get("sources") or []), sep="\n")
        return 0
    question = " ".join(a.question).strip()
    if not question:
        print("A question is required; see --help.", file=sys.stderr)
        return 2
    print(json.dumps(ask(spark, o.database_path, question, a.retrieve), indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())

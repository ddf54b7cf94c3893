"""python -m mnemoflow --db DIR (ingest FILE | query TEXT [-k N] | stats | forget SESSION | serve [SPOOL] | hook SPOOL TRANSCRIPT SESSION | drain SPOOL)"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import MemoryEngine


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="mnemoflow", description=__doc__)
    p.add_argument("--db", required=True)
    p.add_argument("verb", choices=["ingest", "query", "stats", "forget", "serve", "hook", "drain"])
    p.add_argument("what", nargs="*")
    p.add_argument("-k", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = MemoryEngine(spark, a.db)
    if a.verb == "ingest":
        from .sources.jsonl import read_turn_lines

        print(f"{engine.ingest(read_turn_lines(spark, a.what[0]), 'line')} turns ingested")
    elif a.verb == "query":
        found = engine.query(a.what[0], a.k)
        print(f"route: {found['route']}")
        for e in found["evidence"]:
            print(f"{e['score']:6.3f} {e['role']} [{e['session_id']} #{e['session_turn']} {e['speaker']}] {e['text']}")
    elif a.verb == "stats":
        print(json.dumps(engine.stats(), indent=2))
    elif a.verb == "forget":
        print(engine.delete_session(a.what[0]))
    elif a.verb == "hook":
        from .sources.transcripts import read_transcripts
        from .streaming.spool import write_event

        spool, transcript, session = a.what
        write_event(read_transcripts(spark, transcript).withColumn("session_id", F.lit(session)), spool)
    elif a.verb == "drain":
        print(engine.drain(a.what[0]))
    else:
        from .rpc import serve

        before = (lambda: engine.drain(a.what[0])) if a.what else None
        for reply in serve(engine, sys.stdin, before):
            print(reply, flush=True)


if __name__ == "__main__":
    main()

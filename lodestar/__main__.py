"""python -m lodestar VERB STORE ...: the engine's verbs from a shell."""

from __future__ import annotations

import argparse
import json
import sys

from .operators.extraction import Ontology
from .plans.engine import MODES, Engine, Settings
from .session import ship_package, submitted_session


VERBS = [
    "ingest", "build", "ask", "route", "parse", "extract", "facts", "stats", "validate", "export", "delete", "metrics", "quality", "documents", "runs", "preview",
    "preflight", "nightly", "status",
]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("store", help="folder of the store")
    p.add_argument("rest", nargs="*", help="folder to ingest, graph mode, question, text, folder to export to, or source id")
    p.add_argument("--ontology", help="YAML or JSON file")
    p.add_argument("--settings", help="YAML file")
    p.add_argument("--year", type=int, help="what 'the last N years' of a question count back from")
    a = p.parse_args(argv)
    text = " ".join(a.rest)
    spark = submitted_session()
    ship_package(spark)
    engine = Engine(spark, a.store, Ontology.load(a.ontology) if a.ontology else Ontology(), Settings.load(a.settings) if a.settings else None)

    def show(df) -> None:
        for row in df.toLocalIterator():  # a partition at a time
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))

    if a.verb == "ingest":
        show(engine.ingest(text))
    elif a.verb == "build":
        print(json.dumps(engine.build(text if text in MODES else "retrieval_kg")))
    elif a.verb == "ask":
        print(engine.ask(text)["answer"])
    elif a.verb == "route":
        show(engine.route(text))
    elif a.verb == "parse":
        print(engine.parse(text, a.year or 9999))
    elif a.verb == "extract":
        print("\n".join(map(str, engine.extract(text))))
    elif a.verb == "facts":
        print("\n".join(json.dumps(f, ensure_ascii=False) for f in engine.facts(text, a.year)))
    elif a.verb in ("stats", "quality", "documents", "runs"):
        show(getattr(engine, a.verb)())
    elif a.verb == "metrics":
        show(engine.metrics(a.rest or None))
    elif a.verb in ("preview", "preflight"):
        show(getattr(engine, a.verb)(text))
    elif a.verb == "nightly":
        done = engine.nightly(text)
        print(json.dumps(done, ensure_ascii=False))
        return 0 if done["status"] == "done" else 2
    elif a.verb == "status":
        engine.set_status(*a.rest)
    elif a.verb == "validate":
        found = engine.validate()
        show(found)
        return 2 if found.where("level = 'error'").limit(1).count() else 0
    elif a.verb == "export":
        print(json.dumps(engine.store.export(text, "json")))
    elif a.verb == "delete":
        engine.delete_source(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())

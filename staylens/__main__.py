"""python -m staylens index | search: from records to index tables, and searches in them."""

from __future__ import annotations

import argparse

from staylens import build
from staylens.functions import lexicon
from staylens.session import session, ship
from staylens.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="staylens", description="Review search on Spark")
    commands = out.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="clean, tag and index raw records")
    index.add_argument("--records", help="a file that holds one array of records")
    index.add_argument("--lines", help="a file with a record a line, read if there is no array")
    search = commands.add_parser("search", help="rank hotels for queries")
    search.add_argument("queries", nargs="+")
    search.add_argument("--top-k", type=int, default=10)
    for command in (index, search):
        command.add_argument("--index", help="folder of the index tables")
        command.add_argument("--rules", help="YAML file of categories, descriptors, locations and synonyms")
        command.add_argument("--master")
    return out


def main(arguments: list[str] | None = None) -> None:
    given = vars(parser().parse_args(arguments))
    set_ = build.settings({k: given.get(k) for k in build.ENVIRONMENT}, need=("index",))
    rules = lexicon.read_all(set_["rules"]) if "rules" in set_ else {}
    spark = session(master=given["master"])
    ship(spark)
    if given["command"] == "index":
        records = readers.read_records(spark, set_.get("records", ""), given["lines"]) if set_.get("records") else readers.read_records(spark, "-", given["lines"])
        options = {"window": int(set_["context_window"])} if "context_window" in set_ else {}
        build.index(build.process(records, lexicon.rules(rules.get("categories")), lexicon.rules(rules.get("descriptors")), **options), set_["index"])
    else:
        locations = rules.get("locations") or {}
        engine = build.engine(spark, set_["index"], lexicon.aliases(locations), lexicon.keywords(locations), list(rules.get("descriptors") or {}), rules.get("synonyms"))
        print(writers.markdown(engine.search(given["queries"], given["top_k"]).select("query", "rank", "source_hotel_id", "hotel_name", "hybrid_score").orderBy("query", "rank")))


if __name__ == "__main__":
    main()

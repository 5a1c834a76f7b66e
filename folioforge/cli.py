"""Command line: ``python -m folioforge.cli query NAME SF_DIR``, ``queries``, ``languages``, ``filters``, ``engines``, ``packages``, ``check``."""

from __future__ import annotations

import argparse
import sys

from folioforge.plans.selection import ENGINE_OPTIONS, GPU_ENGINES, InputError, page_ranges, parse_engine_options, select_engines


def main(argv: list[str] | None = None) -> int:
    """Runs one command; 2 for a request that can't be met."""
    p = argparse.ArgumentParser(prog="folioforge")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a query and print its rows")
    q.add_argument("name")
    q.add_argument("sf_dir")
    q.add_argument("--rows", type=int, default=20)
    for name in ("queries", "languages", "filters", "engines", "packages"):
        sub.add_parser(name)
    c = sub.add_parser("check", help="test a request without running it")
    c.add_argument("--engines", default="all")
    c.add_argument("--lang", default="eng")
    c.add_argument("--pages", default="all")
    c.add_argument("--preprocess", default="")
    c.add_argument("-O", dest="options", action="append", default=[])
    a = p.parse_args(argv)
    try:
        return _run(a)
    except (InputError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(a: argparse.Namespace) -> int:
    from folioforge.operators.images import FILTERS, parse_filters
    from folioforge.plans.routing import ENGINES, language_rows

    if a.command == "filters":
        print("\n".join(FILTERS))
    elif a.command == "languages":
        print("\n".join(f"{r[1]}\t{r[2]}\t{r[3]}" for r in language_rows()))
    elif a.command == "packages":
        print("\n".join(dict.fromkeys(x for r in language_rows() for x in r[10])))
    elif a.command == "engines":
        for e in ENGINES:
            print(e, *(f"{k}={o.default}" for k, o in ENGINE_OPTIONS[e].items()), sep="\t")
    elif a.command == "check":
        page_ranges(a.pages)
        parse_filters(a.preprocess)
        codes = {r[1] for r in language_rows()}
        wanted = [x.strip() for x in a.lang.split("+")]
        if not all(wanted) or set(wanted) - codes:
            raise InputError(f"unknown or missing language in {a.lang!r}")
        chosen = select_engines(a.engines, list(ENGINES), GPU_ENGINES)
        print("engines:", ", ".join(chosen), parse_engine_options(a.options, chosen))
    else:
        from folioforge.plans.catalog import queries

        if a.command == "queries":
            print("\n".join(queries()))
            return 0
        if a.name not in queries():
            raise InputError(f"no query {a.name!r}")
        from folioforge.session import local_session

        queries()[a.name](local_session(), a.sf_dir).show(a.rows, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())

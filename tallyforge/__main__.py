"""Command line: python -m tallyforge WORKSPACE VERB [ARGUMENT]."""

from __future__ import annotations

import argparse

from tallyforge.api import Workspace
from tallyforge.session import get_session


def main(args: list[str] | None = None, spark=None) -> None:
    p = argparse.ArgumentParser(prog="tallyforge")
    p.add_argument("workspace")
    p.add_argument("verb", choices=["update_catalogs", "scan", "scan_deep", "find_fixes", "report", "status", "fix_catalog", "fix_catalog_red", "check_archives", "export"])
    p.add_argument("argument", nargs="?", default="")
    a = p.parse_args(args)
    w = Workspace(spark or get_session("tallyforge"), a.workspace)
    run = {
        "update_catalogs": lambda: w.update_catalogs(a.argument),
        "scan": lambda: w.scan(a.argument),
        "scan_deep": lambda: w.scan(a.argument, deep=True),
        "find_fixes": w.find_fixes,
        "report": w.report,
        "status": w.status,
        "fix_catalog": w.fix_catalog,
        "fix_catalog_red": lambda: w.fix_catalog(red_only=True),
        "check_archives": w.check_archives,
        "export": lambda: w.export(a.argument),
    }[a.verb]()
    if run is not None:
        run.show(50, truncate=False)


if __name__ == "__main__":
    main()

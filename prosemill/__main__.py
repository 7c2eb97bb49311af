"""python -m prosemill [options] PATH...: lint files. '-' reads standard input."""

from __future__ import annotations

import argparse
import json
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("prosemill", description=__doc__)
    p.add_argument("paths", nargs="*")
    p.add_argument("--format", choices=["json", "sarif", "markdown"], default="json")
    p.add_argument("--profile")
    p.add_argument("--config")
    p.add_argument("--output")
    p.add_argument("--min-severity", choices=["info", "warning", "error"], default="info")
    p.add_argument("--fail-on", choices=["info", "warning", "error", "off"], default="warning")
    p.add_argument("--max-findings", type=int)
    for flag in ("pretty", "rules", "allow-empty", "absolute-paths", "collapse-occurrences"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--version", "-v", action="version", version="0.1.0")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    """The exit status: 0, 1 for findings that fail, 2 for errors."""
    o = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .operators import report
    from .operators.lint import lint
    from .plans import catalogue, config
    from .sources import files

    try:
        settings = config.load(o.config, o.profile) | ({"collapseOccurrences": True} if o.collapse_occurrences else {})
        spark = spark or SparkSession.builder.appName("prosemill").getOrCreate()
        if o.rules:
            out = json.dumps([r.asDict() for r in catalogue.rules(spark).collect()], ensure_ascii=False)
            status = 0
        elif not o.paths:
            parser().print_help()
            return 2
        else:
            base, parts = os.getcwd(), []
            for p in o.paths:
                full = os.path.abspath(p)
                if p == "-":
                    parts.append(files.read_stdin(spark))
                elif os.path.isfile(full):
                    parts.append(files.read_documents(spark, [full], ("[^./]+",), settings.get("ignoreFiles"), base))
                elif os.path.isdir(full):
                    parts.append(files.read_documents(spark, [full], base=base, ignore_files=settings.get("ignoreFiles")))
                else:
                    parts.append(files.read_glob(spark, base, [p], ignore_files=settings.get("ignoreFiles")))
            docs = parts[0]
            for d in parts[1:]:
                docs = docs.unionByName(d)
            docs = docs.dropDuplicates(["path"]).cache()
            if docs.isEmpty() and not o.allow_empty:
                raise FileNotFoundError(f"no file for {' '.join(o.paths)}")
            if o.absolute_paths:
                from pyspark.sql import functions as F

                docs = docs.withColumn("path", F.when(F.col("path").startswith("/") | F.col("path").startswith("<"), F.col("path")).otherwise(F.concat(F.lit(base + "/"), F.col("path"))))
            found = report.at_least(lint(docs, settings), o.min_severity).cache()
            out = {"json": lambda: report.payload(found, docs), "sarif": lambda: report.sarif(found), "markdown": lambda: report.markdown_report(found, docs)}[o.format]()
            status = report.exit_status(found, o.fail_on, o.max_findings)
        if o.pretty and o.format != "markdown":
            out = json.dumps(json.loads(out), ensure_ascii=False, indent=2)
        if o.output:
            os.makedirs(os.path.dirname(os.path.abspath(o.output)), exist_ok=True)
            with open(o.output, "w", encoding="utf-8") as f:
                f.write(out.rstrip("\n") + "\n")
        else:
            print(out)
        return status
    except (ValueError, OSError) as e:
        print(json.dumps({"error": str(e)}, ensure_ascii=False), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

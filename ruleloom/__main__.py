"""python -m ruleloom structure ANALYSIS.json...   the fields of saved analyses, as JSON lines
python -m ruleloom diff BEFORE.json AFTER.json   the fields that two analyses of one form structure differently
python -m ruleloom roles WORKBOOK.xlsx           which column of each sheet has which role, and what has none"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from .operators import rules
from .operators.containment import diff
from .operators.layout import split_composites, structure
from .session import session
from .sources import analysis, sheets


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="ruleloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("structure", "diff", "roles"))
    parser.add_argument("path")
    parser.add_argument("after", nargs="?")
    given = parser.parse_args(argv)
    spark = session()

    def fields(path: str) -> DataFrame:
        read = analysis.read(spark, path)
        return split_composites(structure(analysis.kv_pairs(read), analysis.lines(read)))

    if given.command == "structure":
        for line in fields(given.path).orderBy("doc_id", "field_ord").toJSON().toLocalIterator():
            print(line)
    elif given.command == "diff":
        if not given.after:
            parser.error("diff takes two paths")
        shown = ["kind", "section", "subsection", "key", "value_text", "value_parts"]
        for line in diff(fields(given.path), fields(given.after), ["field_ord"], shown).orderBy("field_ord").toJSON().toLocalIterator():
            print(line)
    else:
        heads = rules.headers(sheets.cells(spark, given.path))
        mapping = rules.resolve_roles(heads)
        mapping.orderBy("sheet", "col0").show(200, False)
        rules.schema_report(heads, mapping).orderBy("sheet").show(200, False)


if __name__ == "__main__":
    main()

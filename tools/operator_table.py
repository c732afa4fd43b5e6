"""Write OPERATORS.md: which queries show which operator of the inventory, and whether SQL checks them."""

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from seriesloom.catalog import COVERS, ORACLES  # noqa: E402


def main():
    by_operator: dict[str, list[str]] = {}
    for name, covers in COVERS.items():
        for op in covers.split():
            by_operator.setdefault(op, []).append(name + ("*" if name in ORACLES else ""))
    lines = ["# Operators and the queries that show them", "",
             "A star marks queries whose whole result is checked against SQL on DuckDB.", "",
             "| operator | queries |", "| --- | --- |"]
    for op in sorted(by_operator, key=lambda o: int(o.split("-")[1])):
        lines.append(f"| {op} | {', '.join(by_operator[op])} |")
    (ROOT / "OPERATORS.md").write_text("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()

"""DuckDB SQL that says what the operators compute: one statement for each, in files by subject.

A statement stands under a comment line with its name; what it reads stands in braces: base tables or other statements.
The texts are kept apart from the operators, which are written for Spark alone.
"""

from __future__ import annotations

import re
from pathlib import Path

_INPUT = re.compile(r"\{([a-z]\w*)\}")


def _texts() -> dict[str, str]:
    out = {}
    for file in sorted(Path(__file__).parent.glob("*.sql")):
        for part in re.split(r"^-- (?=[a-z]\w*$)", file.read_text(), flags=re.M)[1:]:
            name, text = part.split("\n", 1)
            out[name] = text.strip()
    return out


TEXTS = _texts()


def oracle(name: str) -> str:
    """One DuckDB query over the base tables."""
    seen: dict[str, None] = {}

    def visit(n: str) -> None:
        for i in _INPUT.findall(TEXTS[n]):
            if i in TEXTS and i not in seen:
                visit(i)
        seen[n] = None

    visit(name)
    parts = [f"{n} AS ({_INPUT.sub(r'\1', TEXTS[n])})" for n in seen]
    return f"WITH {', '.join(parts)} SELECT * FROM {name}"

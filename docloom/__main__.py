"""``python -m docloom JSON PATH``: the matches of a path, one on each line."""

from __future__ import annotations

import sys

from .codec import dumps, loads
from .path.evaluate import values
from .path.rewrite import compile_path


def main(args: list[str]) -> int:
    if len(args) != 2:
        print("usage: python -m docloom JSON PATH", file=sys.stderr)
        return 2
    try:
        found = values(compile_path(args[1]), loads(args[0]))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    for value in found:
        print(dumps(value))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

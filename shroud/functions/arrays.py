"""Running values over arrays, as SQL text, in time about proportional to their length."""

from __future__ import annotations

from collections.abc import Callable

#: A fold that appends copies what it has, so it runs over blocks of this many elements.
BLOCK = 128


def plus(s: str, v: str) -> str:
    return f"{s} + {v}"


def running(array: str, merge: Callable[[str, str], str] = plus, zero: str = "0L", kind: str = "bigint") -> str:
    """For each element, all elements before it merged, ``zero`` before the first. ``merge`` must be associative: blocks are merged on their own,
    then the blocks' results, then each block from where it begins. The array's own text is repeated: pass a column or a lambda's variable."""

    def fold(x: str, first: str) -> str:
        return f"aggregate({x}, named_struct('s', {first}, 'a', cast(array() as array<{kind}>)), (acc, v) -> named_struct('s', {merge('acc.s', 'v')}, 'a', array_append(acc.a, acc.s)), acc -> acc.a)"

    blocks = f"transform(sequence(0, greatest(0, size({array}) - 1) div {BLOCK}), b -> slice({array}, cast(b * {BLOCK} + 1 as int), {BLOCK}))"
    totals = f"transform({blocks}, x -> aggregate(x, {zero}, (s, v) -> {merge('s', 'v')}))"
    return f"flatten(zip_with({blocks}, {fold(totals, zero)}, (x, first) -> {fold('x', 'first')}))"

"""Row programs: solvers that fit a rule to examples and answer a query, or abstain with a reason.

A puzzle is a row (id, inputs, outputs, query), all strings. solve() runs the
named solvers on Arrow batches; an answer counts only if every solver that fits
all examples gives the same one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame

Rule = Callable[[str], str | None]
Fit = Callable[[list[str], list[str]], Rule | None]


def _checked(rule: Rule, xs: list[str], ys: list[str]) -> Rule | None:
    return rule if xs and all(rule(x) == y for x, y in zip(xs, ys, strict=True)) else None


def fit_bits(xs: list[str], ys: list[str]) -> Rule | None:
    """XOR with a constant, inversion, rotation or reversal of bit strings of one length."""
    if not xs or any(set(s) - {"0", "1"} or len(s) != len(xs[0]) or not s for s in (*xs, *ys)):
        return None
    n = len(xs[0])
    mask = int(xs[0], 2) ^ int(ys[0], 2)
    rules: list[Rule] = [lambda s: f"{int(s, 2) ^ mask:0{n}b}", lambda s: s[::-1]]
    rules += [lambda s, k=k: s[k:] + s[:k] for k in range(1, n)]
    rules += [lambda s, k=k: "".join("10"[int(c)] for c in s[k:] + s[:k]) for k in range(1, n)]
    return next((r for r in rules if _checked(r, xs, ys)), None)


def _decimal(s: str) -> Decimal | None:
    try:
        return Decimal(s)
    except (InvalidOperation, TypeError):
        return None


def fit_number(xs: list[str], ys: list[str]) -> Rule | None:
    """Scale, offset, line, or scaled square in exact decimals, to the places the outputs show."""
    a, b = [_decimal(x) for x in xs], [_decimal(y) for y in ys]
    if not a or None in a or None in b:
        return None
    places = max((len(y.partition(".")[2]) for y in ys), default=0)
    show = lambda d: str(d.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))

    def made(f: Callable[[Decimal], Decimal]) -> Rule:
        def rule(s: str) -> str | None:
            d = _decimal(s)
            return None if d is None else show(f(d))

        return rule

    forms: list[Callable[[Decimal], Decimal]] = [lambda d: d + (b[0] - a[0])]
    if a[0]:
        forms += [lambda d: d * (b[0] / a[0]), lambda d: d * d * (b[0] / (a[0] * a[0]))]
    if len(a) > 1 and a[0] != a[1]:
        m = (b[1] - b[0]) / (a[1] - a[0])
        forms.append(lambda d: m * d + (b[0] - m * a[0]))
    # A form that gives the outputs exactly goes before one that needs rounding.
    exact = [f for f in forms if all(abs(f(x) - y) < Decimal("1e-12") for x, y in zip(a, b, strict=True))]
    return next((r for f in (*exact, *forms) if _checked(r := made(f), xs, ys)), None)


def fit_shift(xs: list[str], ys: list[str]) -> Rule | None:
    """A shift of the letters' alphabet, reversal, or both."""
    first = next((((ord(y) - ord(x)) % 26) for x, y in zip(xs[0], ys[0], strict=False) if x.isascii() and x.islower() and y.isascii() and y.islower()), 0) if xs and ys else 0
    back = next((((ord(y) - ord(x)) % 26) for x, y in zip(xs[0][::-1], ys[0], strict=False) if x.isascii() and x.islower() and y.isascii() and y.islower()), 0) if xs and ys else 0
    move = lambda s, k: "".join(chr((ord(c) - 97 + k) % 26 + 97) if c.isascii() and c.islower() else chr((ord(c) - 65 + k) % 26 + 65) if c.isascii() and c.isupper() else c for c in s)
    return next((r for r in (lambda s: move(s, first), lambda s: move(s[::-1], back)) if _checked(r, xs, ys)), None)


def fit_map(xs: list[str], ys: list[str]) -> Rule | None:
    """A map of characters, each always to the same one; queries must be covered."""
    table: dict[str, str] = {}
    for x, y in zip(xs, ys, strict=True):
        if len(x) != len(y) or any(table.setdefault(p, q) != q for p, q in zip(x, y, strict=True)):
            return None
    return _checked(lambda s: "".join(table[c] for c in s) if all(c in table for c in s) else None, xs, ys) if table else None


#: Roman numerals of each step.
_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def to_roman(s: str) -> str | None:
    if not s.isdigit() or not 1 <= int(s) <= 3999:
        return None
    n, out = int(s), ""
    for v, w in _ROMAN:
        out, n = out + w * (n // v), n % v
    return out


def fit_roman(xs: list[str], ys: list[str]) -> Rule | None:
    return _checked(to_roman, xs, ys)


def fit_sequence(xs: list[str], ys: list[str]) -> Rule | None:
    """Outputs that follow a line or a ratio over the inputs' positions 1, 2, 3."""
    if not all(x.isdigit() for x in xs) or any(_decimal(y) is None for y in ys) or len(xs) < 3:
        return None
    pts = sorted((int(x), int(Decimal(y))) for x, y in zip(xs, ys, strict=True))
    (i, p), (j, q) = pts[0], pts[1]
    rules: list[Rule] = []
    if (q - p) % (j - i) == 0:
        d = (q - p) // (j - i)
        rules.append(lambda s: str(p + d * (int(s) - i)))
    if j - i == 1 and p and q % p == 0:
        r = q // p
        rules.append(lambda s: str(p * r ** (int(s) - i)) if int(s) >= i else None)
    return next((r_ for r_ in rules if _checked(r_, xs, ys)), None)


SOLVERS: dict[str, Fit] = {"bits": fit_bits, "number": fit_number, "shift": fit_shift, "map": fit_map, "roman": fit_roman, "sequence": fit_sequence}


def answer(xs: list[str], ys: list[str], q: str, names: list[str]) -> tuple[str | None, str, str]:
    """(answer, solvers that fit, reason)."""
    got: dict[str, str] = {}
    for name in names:
        rule = SOLVERS[name](xs, ys)
        value = rule(q) if rule else None
        if value is not None:
            got[name] = value
    if not got:
        return None, "", "no_rule"
    if len(set(got.values())) > 1:
        return None, ",".join(got), "disagreement"
    return next(iter(got.values())), ",".join(got), "verified"


def solve(df: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """(key, answer, solvers, reason) of puzzles (key, inputs array<string>, outputs array<string>, query)."""
    chosen = names or list(SOLVERS)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [answer(xs or [], ys or [], q or "", chosen) for xs, ys, q in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], pa.string()) for i in range(3))], names=[key, "answer", "solvers", "reason"])

    return df.select(key, "inputs", "outputs", "query").mapInArrow(run, f"{key} {kind}, answer string, solvers string, reason string")


#: The small language of execute(): steps that take and give a list of strings.
STEPS: dict[str, Callable[[list[str], str], list[str]]] = {
    "split": lambda v, a: [p for x in v for p in x.split(a or None)], "take": lambda v, a: v[: int(a)], "last": lambda v, a: v[-int(a or 1) :], "drop": lambda v, a: v[int(a) :],
    "upper": lambda v, a: [x.upper() for x in v], "lower": lambda v, a: [x.lower() for x in v], "reverse": lambda v, a: v[::-1], "mirror": lambda v, a: [x[::-1] for x in v],
    "sort": lambda v, a: sorted(v), "unique": lambda v, a: list(dict.fromkeys(v)), "count": lambda v, a: [str(len(v))], "lengths": lambda v, a: [str(len(x)) for x in v],
    "join": lambda v, a: [a.join(v)], "prefix": lambda v, a: [a + x for x in v], "suffix": lambda v, a: [x + a for x in v], "digits": lambda v, a: ["".join(c for c in x if c.isdigit()) for x in v],
    "sum": lambda v, a: [str(sum(int(x) for x in v if x.lstrip("-").isdigit()))], "max": lambda v, a: [max(v, key=len)] if v else [], "sub": lambda v, a: [x.replace(*a.split(">", 1)) for x in v],
}


def execute(program: str, value: str) -> str | None:
    """Runs "step:argument|step|..." on a value; None if a step is unknown or fails."""
    v = [value]
    try:
        for part in program.split("|"):
            name, _, arg = part.partition(":")
            v = STEPS[name](v, arg)
    except (KeyError, ValueError, IndexError):
        return None
    return " ".join(v)


def run_programs(df: DataFrame, key: str, text: str, programs: list[str]) -> DataFrame:
    """(key, program, result): every program on every text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for p in programs:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p] * len(texts), pa.string()), pa.array([execute(p, t or "") for t in texts], pa.string())], names=[key, "program", "result"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, program string, result string")

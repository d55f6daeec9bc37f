"""Programs that differ in a sign only are different records; writing alone makes none."""

import pytest

pytest.importorskip("barlattice.llm")
from barlattice.llm.canonical import canonical_code  # noqa: E402

BODY = "def f(df, n={n}):\n    a = df['close'] {op} df['volume']\n    return {sign}a"


def code(n="5", op="*", sign=""):
    return BODY.format(n=n, op=op, sign=sign)


DIFFERENT = [
    [code(op=x) for x in ("*", "/", "%", "&", "@", "-", "+", "**", "//", "<", "<=", "==", "!=", "|", "^")],
    [code(), code(n="-5"), code(n=".5"), code(n="0.5"), code(n="50"), code(sign="-"), code(sign="not ")],
    [code(), code() + "  # a", code().replace("return", "# return")],
    ["n: 5", "n: -5", "n: .5", "n = - 5.5"],
    ["mix: a * b", "mix: a / b", "mix: a - b", "mix: a + b", "mix: -a + b", "mix: a % b", "mix: a ** b"],
]
SAME = [
    [code(), code().upper(), code().replace("'", '"'), code().replace("'", "”"), code().replace("\n", " ;\r\n"), code().replace(" = ", "=")],
    [code(op="-"), code(op="–"), code(op="−").replace("−", "-")],
    ["n: -5; kind: mean-reversion", "KIND = 'mean reversion', N = -5", "kind : mean_reversion\nn: - 5", '{"n": -5, "kind": "mean–reversion"}'.replace("–", "-")],
    ["n: 5!; day: 2024-01-02", "day = 20240102, n = 5"],
]


@pytest.mark.parametrize("texts", DIFFERENT)
def test_signs_tell_programs_apart(texts):
    assert len({canonical_code(x) for x in texts}) == len(texts)


@pytest.mark.parametrize("texts", SAME)
def test_writing_does_not(texts):
    assert len({canonical_code(x) for x in texts}) == 1

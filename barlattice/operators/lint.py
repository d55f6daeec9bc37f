"""Static checks of factor code, on the driver and without running it."""

from __future__ import annotations

import ast

# What factor code may import and must not call.
ALLOWED_IMPORTS = ("math", "numpy", "pandas", "scipy")
FORBIDDEN_CALLS = ("eval", "exec", "open", "compile", "__import__", "input", "globals", "locals", "getattr", "setattr", "delattr", "vars")
#: Window functions: names of the options that tell their length, and the length without any (None: not told).
WINDOWED = {"rolling": (("window",), None), "diff": (("periods",), 1.0), "pct_change": (("periods",), 1.0), "ewm": (("span", "halflife", "com"), None)}


def _number(node: ast.expr | None, names: dict[str, float]) -> float | None:
    """Value of a constant, a negated constant or a name bound to one."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return float(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        inner = _number(node.operand, names)
        return None if inner is None else -inner
    if isinstance(node, ast.Name):
        return names.get(node.id)
    return None


def _bound(tree: ast.AST) -> dict[str, float]:
    """Names bound to numbers by assignment or as defaults of parameters."""
    names: dict[str, float] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            value = _number(node.value, names)
            if value is not None:
                names[node.targets[0].id] = value
        elif isinstance(node, ast.FunctionDef):
            given = node.args.args[len(node.args.args) - len(node.args.defaults) :]
            for arg, default in zip(given, node.args.defaults):
                value = _number(default, names)
                if value is not None:
                    names[arg.arg] = value
    return names


def _length(name: str, call: ast.Call, options: dict[str | None, ast.expr], names: dict[str, float]) -> float | None:
    """Bars that a window function looks back: the shortest that is told, else its default, else None."""
    told, default = WINDOWED[name]
    given = [options[k] for k in told if k in options] + (call.args[:1] if name != "ewm" else [])
    if not given:
        return default
    lengths = [x for x in (_number(g, names) for g in given) if x is not None]
    return min(lengths) if lengths else None


def _adds(node: ast.expr, names: dict[str, float]) -> bool:
    """Whether an index goes forward from another place: ``i + 1``, also within a slice or a tuple."""
    for part in ast.walk(node):
        if isinstance(part, ast.BinOp) and isinstance(part.op, ast.Add):
            if any((_number(side, names) or 0) >= 1 for side in (part.left, part.right)):
                return True
    return False


def check_code(code: str, shortest: int = 12, control: bool = False) -> list[str]:
    """What is wrong with a factor's code; empty if nothing is.

    Found are: syntax errors, imports and calls that are not allowed, private
    attributes, look-ahead (negative shifts, forward ``iloc`` and ``loc``, centred windows,
    back filling) and look-backs shorter than ``shortest`` bars; ``diff`` and
    ``pct_change`` without a length look back one bar.  A positive ``control`` may look
    ahead: what begins with ``look-ahead`` is left out for it.
    """
    found = _check(code, shortest)
    return [f for f in found if not f.startswith("look-ahead")] if control else found


def _check(code: str, shortest: int) -> list[str]:
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [f"syntax error in line {e.lineno}"]
    names, found = _bound(tree), []
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            modules = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""]
            found += [f"import of {m}" for m in modules if m.split(".")[0] not in ALLOWED_IMPORTS]
        elif isinstance(node, ast.Attribute) and node.attr.startswith("_"):
            found.append(f"private attribute {node.attr}")
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else ""
            if isinstance(node.func, ast.Name) and name in FORBIDDEN_CALLS:
                found.append(f"call of {name}")
            options = {k.arg: k.value for k in node.keywords}
            first = _number(node.args[0] if node.args else next((options[k] for k in ("periods", "n") if k in options), None), names)
            if name == "shift" and first is not None and first < 0:
                found.append("look-ahead by shift")
            if name in ("bfill", "backfill"):
                found.append("look-ahead by back filling")
            if name == "rolling" and isinstance(options.get("center"), ast.Constant) and options["center"].value:
                found.append("look-ahead by a centred window")
            if name in WINDOWED and isinstance(node.func, ast.Attribute):
                length = _length(name, node, options, names)
                if length is not None and abs(length) < shortest:
                    found.append(f"{name} over {length:g} bars is too short")
            if name in ("diff", "pct_change") and first is not None and first < 0:
                found.append(f"look-ahead by {name}")
        elif isinstance(node, ast.Subscript) and isinstance(node.value, ast.Attribute) and node.value.attr in ("iloc", "loc") and _adds(node.slice, names):
            found.append(f"look-ahead by {node.value.attr}")
    return found

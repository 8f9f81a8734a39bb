"""SQL text of the special functions, for the reference queries of the catalogue."""

from __future__ import annotations

from synthframe.functions import special


def _poly(coefficients, x: str) -> str:
    text = repr(float(coefficients[0]))
    for c in coefficients[1:]:
        text = f"({text} * {x} + {float(c)!r})"
    return text


def norm_cdf(x: str) -> str:
    """Standard normal CDF of a column name (the name is repeated, so keep it short)."""
    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2)"
    near = f"{e} * {_poly(special.CDF_NUM, z)} / {_poly(special.CDF_DEN, z)}"
    far = f"{e} / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / {special.SQRT_2PI}"
    tail = f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < {special.CDF_SPLIT} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_ppf(p: str) -> str:
    """Standard normal quantile of a column name."""
    q, c = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    t = f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"{q} * {_poly(special.PPF_CENTRE_NUM, c)} / {_poly(special.PPF_CENTRE_DEN, c)}"
    tail = f"{_poly(special.PPF_TAIL_NUM, f'({t} - 1.6)')} / {_poly(special.PPF_TAIL_DEN, f'({t} - 1.6)')}"
    far = f"{_poly(special.PPF_FAR_NUM, f'({t} - 5.0)')} / {_poly(special.PPF_FAR_DEN, f'({t} - 5.0)')}"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {centre} "
            f"ELSE sign({q}) * (CASE WHEN {t} <= 5 THEN {tail} ELSE {far} END) END)")


def md5_number(row_id: str, stream: str, seed: int = 0) -> str:
    return (f"cast('0x' || substr(md5(cast({row_id} as varchar) || ':{stream}:{seed}'), 1, 8) as bigint)")


def md5_uniform(row_id: str, stream: str, seed: int = 0) -> str:
    return f"(({md5_number(row_id, stream, seed)} + 0.5) / 4294967296.0)"


def clamp(p: str, eps: float = special.CLAMP) -> str:
    return f"(CASE WHEN {p} <= {eps!r} THEN {eps!r} WHEN {p} >= 1 - {eps!r} THEN 1 - {eps!r} ELSE {p} END)"


def unpivot(table: str, columns, keep: str = "", cast: str = "double") -> str:
    """UNION ALL of (keep, column, value) per column."""
    head = f"{keep}, " if keep else ""
    return " UNION ALL ".join(f"SELECT {head}'{c}' AS \"column\", cast({c} as {cast}) AS value FROM {table}"
                              for c in columns)

"""Colour conversions as SQL expressions over double columns b, g, r (0…255).

They follow the 8-bit conventions: hue 0…179, L scaled to 0…255, a and b shifted by
128. Numbers are written in exponent form so that they are doubles, not decimals.
"""

_MAX, _MIN = "greatest(b, g, r)", "least(b, g, r)"
_SPAN = f"({_MAX} - {_MIN})"

GRAY = "floor(2.99e-1 * r + 5.87e-1 * g + 1.14e-1 * b + 5e-1)"
VALUE = _MAX
SATURATION = f"CASE WHEN {_MAX} = 0 THEN 0e0 ELSE floor(2.55e2 * {_SPAN} / {_MAX} + 5e-1) END"
_ANGLE = f"""CASE WHEN {_SPAN} = 0 THEN 0e0 WHEN {_MAX} = r THEN 6e1 * (g - b) / {_SPAN}
 WHEN {_MAX} = g THEN 1.2e2 + 6e1 * (b - r) / {_SPAN} ELSE 2.4e2 + 6e1 * (r - g) / {_SPAN} END"""
HUE = f"(floor((CASE WHEN ({_ANGLE}) < 0 THEN ({_ANGLE}) + 3.6e2 ELSE ({_ANGLE}) END) / 2e0 + 5e-1) % 1.8e2)"


def _linear(channel: str) -> str:
    share = f"({channel} / 2.55e2)"
    return f"CASE WHEN {share} <= 4.045e-2 THEN {share} / 1.292e1 ELSE power(({share} + 5.5e-2) / 1.055e0, 2.4e0) END"


_R, _G, _B = (f"({_linear(c)})" for c in "rgb")
_X = f"((4.12453e-1 * {_R} + 3.5758e-1 * {_G} + 1.80423e-1 * {_B}) / 9.50456e-1)"
_Y = f"(2.12671e-1 * {_R} + 7.1516e-1 * {_G} + 7.2169e-2 * {_B})"
_Z = f"((1.9334e-2 * {_R} + 1.19193e-1 * {_G} + 9.50227e-1 * {_B}) / 1.088754e0)"


def _cube(t: str) -> str:
    return f"CASE WHEN {t} > 8.856e-3 THEN power({t}, 1e0 / 3e0) ELSE 7.787e0 * {t} + 1.6e1 / 1.16e2 END"


def lab(x: str = "lx", y: str = "ly", z: str = "lz") -> tuple[str, str, str]:
    """L, a, b from named columns holding X, Y, Z."""
    light = f"CASE WHEN {y} > 8.856e-3 THEN 1.16e2 * power({y}, 1e0 / 3e0) - 1.6e1 ELSE 9.033e2 * {y} END"
    byte = lambda e: f"least(2.55e2, greatest(0e0, floor({e} + 5e-1)))"
    return (
        byte(f"({light}) * 2.55e0"),
        byte(f"5e2 * (({_cube(x)}) - ({_cube(y)})) + 1.28e2"),
        byte(f"2e2 * (({_cube(y)}) - ({_cube(z)})) + 1.28e2"),
    )


XYZ = {"lx": _X, "ly": _Y, "lz": _Z}
HUE_ANGLE = "hue * (2e0 * pi() / 1.8e2)"
EXCESS_GREEN = "least(1e0, greatest(-1e0, (2e0 * g - r - b) / 2.55e2))"

# HSV boxes of vegetation and open ground.
VEGETATION_HSV = ((25, 95), (35, 255), (25, 255))
GROUND_HSV = ((5, 30), (20, 230), (20, 220))
GREEN_HSV = ((19, 105), (24, 255), (18, 255))


def in_box(box) -> str:
    return " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in zip(("hue", "sat", "val"), box))

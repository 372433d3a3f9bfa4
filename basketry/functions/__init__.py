from basketry.functions.columns import clean_symbol, date_parts, ratio, rescale_range
from basketry.functions.rng import draw, draw_mod, unit

__all__ = ["clean_symbol", "date_parts", "ratio", "rescale_range", "draw", "draw_mod", "unit"]

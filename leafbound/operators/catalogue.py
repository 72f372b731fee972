"""All operators, by importing the modules that declare them."""

from leafbound.sources import samples, views  # noqa: F401, I001
from leafbound.operators import evaluate, fusion, layout, pairs, planning, quality, repair, segments, sinks, text, visual  # noqa: F401

"""Named queries: the operators applied to the driver tables, each with its SQL oracle."""

from importlib import import_module

from .registry import ORACLES, QUERIES  # noqa: F401

# later modules use SQL views declared by earlier ones
MODULES = ("sources", "align", "features", "rules", "stats", "rank", "expect", "model", "analogue", "regime", "backtest", "quantile", "report")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")

"""Strategy parameters.  Every field is stored, so a saved strategy re-tests as itself."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.rules import features_of, look_back


@dataclass(frozen=True)
class Strategy:
    """``stop``/``target``: ("fixed", percent) or ("atr", multiple); ``stop`` also ("swing", bars); None = none.
    ``trail``: ("atr", multiple), ("swing",) or None.  ``max_hold`` 0 = no time exit."""

    name: str
    entry: tuple
    exit: tuple | None = None
    regime: tuple | None = None
    direction: int = 1
    stop: tuple | None = ("fixed", 2.0)
    target: tuple | None = ("fixed", 4.0)
    trail: tuple | None = None
    fee_bps: float = 30.0
    slip_bps: float = 8.0
    max_hold: int = 150
    max_losses: int = 0
    cooldown: int = 0
    vol_threshold: float | None = None
    risk: float = 1.0

    @property
    def warmup(self) -> int:
        return max(10, *(look_back(r) for r in (self.entry, self.exit, self.regime))) + 200

    def features(self) -> list[str]:
        return features_of(self.entry, self.exit, self.regime)


# Presets of the simple engine, with their exit rules.
SIMPLE_PRESETS = [
    Strategy("ema_cross", ("CrossUp", "EMA20", "EMA50"), exit=("CrossDown", "EMA20", "EMA50"), stop=("fixed", 2.0), target=("fixed", 4.0), max_hold=150),
    Strategy("rsi_dip", ("AND", ("LT", "RSI14", 30.0), ("Rising", "EMA20", 5)), exit=("GT", "RSI14", 70.0),
             stop=("fixed", 1.5), target=("fixed", 3.0), max_hold=100),
    Strategy("macd_cross", ("CrossUp", "MACD", "MACD_Signal"), exit=("CrossDown", "MACD", "MACD_Signal"), stop=("fixed", 2.5), target=("fixed", 5.0), max_hold=120),
]

# Preset strategies.
PRESETS = [
    Strategy("ema_cross", ("CrossUp", "EMA20", "EMA50"), stop=("fixed", 2.0), target=("fixed", 4.0), max_hold=150),
    Strategy("rsi_dip", ("AND", ("LT", "RSI14", 30.0), ("Rising", "EMA20", 5)),
             stop=("fixed", 1.5), target=("fixed", 3.0), max_hold=100),
    Strategy("macd_cross", ("CrossUp", "MACD", "MACD_Signal"), stop=("fixed", 2.5), target=("fixed", 5.0), max_hold=120),
]

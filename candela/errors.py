"""Errors that carry a stable code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager


class MarketDataError(Exception):
    code = "MD_ERROR"

    def __init__(self, message: str = "", **details: object):
        super().__init__(f"{self.code}: {message}" if message else self.code)
        self.details = details


def _kind(code: str, *bases: type) -> type:
    return type("".join(x.capitalize() for x in code.removeprefix("MD_").split("_")), bases or (MarketDataError,), {"code": code})


SymbolAmbiguous = _kind("MD_SYMBOL_AMBIGUOUS")
SymbolUnsupported = _kind("MD_SYMBOL_UNSUPPORTED")
TimeframeUnsupported = _kind("MD_TIMEFRAME_UNSUPPORTED")
InvalidExchangeResponse = _kind("MD_INVALID_EXCHANGE_RESPONSE")
PaginationStalled = _kind("MD_PAGINATION_STALLED")
ValidationError = _kind("MD_VALIDATION_ERROR")
MissingFinality = _kind("MD_MISSING_FINALITY", ValidationError)
BarConflict = _kind("MD_BAR_CONFLICT", ValidationError)
IntrabarDataUnavailable = _kind("MD_INTRABAR_DATA_UNAVAILABLE")
RuntimeIntrabarUnsupported = _kind("MD_RUNTIME_INTRABAR_UNSUPPORTED")
NetworkUnavailable = _kind("MD_NETWORK_UNAVAILABLE")
UnsupportedFeature = _kind("MD_UNSUPPORTED_FEATURE")
CacheConflict = _kind("MD_CACHE_CONFLICT")
WsRestCandleMismatch = _kind("MD_WS_REST_CANDLE_MISMATCH")
SymbolNotTradableForStream = _kind("MD_SYMBOL_NOT_TRADABLE_FOR_STREAM")


_BY_CODE = {k.code: k for k in list(globals().values()) if isinstance(k, type) and issubclass(k, MarketDataError)}
_CODED = re.compile(r"(MD_[A-Z_]+): ([^\n]*)")


def coded(error: BaseException) -> MarketDataError | None:
    """The error that a failed Spark job stands for, by the code in its message; null if it carries none."""
    found = _CODED.search(str(error))
    return _BY_CODE[found[1]](found[2].strip()) if found and found[1] in _BY_CODE else None


@contextmanager
def from_jobs() -> Iterator[None]:
    """Around actions: a job that a rule stopped raises the error of its code."""
    try:
        yield
    except MarketDataError:
        raise
    except Exception as error:
        made = coded(error)
        if made is None:
            raise
        raise made from error


class ContractError(ValueError):
    """A query, instrument, bar or series that breaks its contract."""


class InvalidInstrument(ContractError):
    pass


class InvalidTimeframe(ContractError):
    pass


class InvalidBar(ContractError):
    pass


class InvalidBarQuery(ContractError):
    pass


class CoverageError(ContractError):
    pass

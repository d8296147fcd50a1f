"""The instrument catalog: a nested configuration with a version, checked, as tables."""

from __future__ import annotations

import json
import re
from collections import Counter
from pathlib import Path
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession

from brookline.operators import sinks

# Asset classes with the prefixes of their keys, the quote convention of exchange rates, and the forms of keys, currencies and symbols.
PREFIXES = {"index": "index:", "fx": "fx:", "commodity": "commodity:", "us_equity": "us-stock:"}
CONVENTION = "local_currency_per_usd"
KEY, CURRENCY, SYMBOL = r"[a-z0-9]+:[a-z0-9][a-z0-9-]*", r"[A-Z]{3}", r"[A-Z0-9.-]+"

INSTRUMENT = "instrument_key string, display_name string, asset_class string, currency string, exchange string, timezone string, provider_aliases map<string,string>, session_metadata string, quote_convention string, is_active boolean"
EXPOSURE = "symbol string, instrument_key string, reason string, display_order int"
#: Fields of an instrument, those that may be left out last.
REQUIRED, OPTIONAL = ("instrument_key", "display_name", "asset_class", "currency", "timezone", "provider_aliases", "session_metadata"), ("exchange", "quote_convention", "is_active")


def whole(pattern: str, value: object) -> bool:
    return isinstance(value, str) and re.fullmatch(pattern, value) is not None


def instrument_problems(i: dict) -> list[str]:
    key, kind = str(i.get("instrument_key")), i.get("asset_class")
    aliases = i.get("provider_aliases")
    checks = [
        (not (set(i) - set(REQUIRED) - set(OPTIONAL)), "unknown fields"),
        (whole(KEY, i.get("instrument_key")), "not a valid key"),
        (bool(i.get("display_name")), "no name"),
        (kind in PREFIXES, f"unknown asset class {kind}"),
        (kind not in PREFIXES or key.startswith(PREFIXES[kind]), f"a key of class {kind} starts with {PREFIXES.get(kind)}"),
        (whole(CURRENCY, i.get("currency")), "no currency of three capitals"),
        (i.get("timezone") in available_timezones(), f"unknown time zone {i.get('timezone')}"),
        (isinstance(aliases, dict) and bool(aliases) and all(str(k).strip() and str(v).strip() for k, v in aliases.items()), "no provider aliases, or blank ones"),
        (isinstance(i.get("session_metadata"), dict), "no session metadata"),
        (i.get("quote_convention") == (CONVENTION if kind == "fx" else None), f"quote convention is {CONVENTION} for exchange rates and none for others"),
    ]
    return [f"{key}: {text}" for ok, text in checks if not ok]


def problems(catalog: dict) -> list[str]:
    """What is wrong with a catalog; empty if nothing is."""
    instruments, symbols = catalog.get("instruments") or [], catalog.get("stock_exposures") or []
    out = [] if catalog.get("version") == 1 else ["the version is not 1"]
    out += [] if instruments else ["no instruments"]
    out += [p for i in instruments for p in instrument_problems(i)]
    keys = Counter(i.get("instrument_key") for i in instruments)
    out += [f"{k}: listed {n} times" for k, n in keys.items() if n > 1]
    for s in symbols:
        own = s.get("exposures") or []
        if not whole(SYMBOL, s.get("symbol")):
            out.append(f"{s.get('symbol')}: not a valid symbol")
        out += [f"{s.get('symbol')}: {k} listed {n} times" for k, n in Counter(e.get("instrument_key") for e in own).items() if n > 1]
        for e in own:
            if e.get("instrument_key") not in keys:
                out.append(f"{s.get('symbol')}: unknown instrument {e.get('instrument_key')}")
            if not e.get("reason"):
                out.append(f"{s.get('symbol')}: no reason for {e.get('instrument_key')}")
            if (e.get("display_order") or 0) < 0:
                out.append(f"{s.get('symbol')}: negative display order")
    return out


def load(spark: SparkSession, catalog: dict | str) -> tuple[DataFrame, DataFrame]:
    """(instruments, exposures) of a catalog or the path of one (JSON, or YAML where its reader is installed)."""
    if isinstance(catalog, str):
        text = Path(catalog).read_text()
        if catalog.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("reading YAML needs the yaml package") from e
            catalog = yaml.safe_load(text)
        else:
            catalog = json.loads(text)
    if found := problems(catalog):
        raise ValueError("; ".join(found))
    names = [f.split()[0] for f in INSTRUMENT.split(", ")]
    instruments = [tuple(json.dumps(i[n], sort_keys=True, separators=(",", ":")) if n == "session_metadata" else i.get(n, True if n == "is_active" else None) for n in names) for i in catalog["instruments"]]
    exposures = [(s["symbol"], e["instrument_key"], e["reason"], e.get("display_order") or 0) for s in catalog.get("stock_exposures") or [] for e in s.get("exposures") or []]
    return spark.createDataFrame(instruments, INSTRUMENT), spark.createDataFrame(exposures, EXPOSURE)


def merged(known: DataFrame, listed: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """A stored catalog table after a newer catalog: listed rows are added or overwritten and stamped, others stay as they were."""
    return sinks.upsert(known, listed.withColumn("updated_at", now), keys)

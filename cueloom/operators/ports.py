"""Ports: registries of backends, translators as batch functions, and their decorators.

A translator maps a batch table (key..., win_idx, texts, before, after) to one with
``ok`` (the translations) and ``error``. Remote backends run in ``mapInPandas`` and
must be idempotent by batch key, as tasks may run again.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class PortError(ValueError):
    """A provider that is not known or cannot be built."""


@dataclass
class Registry:
    """Named constructors. Unknown names raise an error that lists the known ones."""

    kind: str
    makers: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str) -> Callable:
        def put(f: Callable) -> Callable:
            self.makers[name] = f
            return f

        return put

    def make(self, name: str, config: dict | None = None):
        if name not in self.makers:
            raise PortError(f"no {self.kind} named {name!r}; known: {sorted(self.makers)}")
        return self.makers[name](config or {})

    def first(self, names: list[str], config: dict | None = None):
        """The first of the names that can be built; if none can, an error with every failure."""
        failures = {}
        for n in dict.fromkeys(names):
            try:
                return n, self.make(n, config)
            except Exception as e:  # noqa: BLE001
                failures[n] = str(e)
        raise PortError(f"no {self.kind} available: {failures}")


translators, transcribers, segmenters, composers = Registry("translator"), Registry("transcriber"), Registry("segmenter"), Registry("composer")
#: What a transcriber wants of spans, and what a segmenter gives.
NEEDS = {"canary": "utterance", "parakeet": "utterance", "qwen3-asr": "utterance"}
GIVES = {"grid": "fixed-window", "silero-vad": "utterance"}


def incompatible(transcriber: str | None, segmenter: str | None) -> bool:
    """Only a declared need for utterances against declared fixed windows is refused."""
    return NEEDS.get(transcriber or "") == "utterance" and GIVES.get(segmenter or "") == "fixed-window"


@translators.register("identity")
def _identity(config: dict) -> Callable[[DataFrame], DataFrame]:
    return lambda batches: batches.withColumn("ok", F.col("texts")).withColumn("error", F.lit(None).cast("string"))


@translators.register("upper")
def _upper(config: dict) -> Callable[[DataFrame], DataFrame]:
    return lambda batches: batches.withColumn("ok", F.transform("texts", F.upper)).withColumn("error", F.lit(None).cast("string"))


@translators.register("http")
def _http(config: dict) -> Callable[[DataFrame], DataFrame]:
    """A chat endpoint behind ``config["call"]``, a picklable function from a request to (status, body)."""
    if "call" not in config:
        raise PortError("translator 'http' needs config['call']")
    return lambda batches: chat_translate(batches, config["call"], config)


@transcribers.register("stub")
def _stub(config: dict) -> Callable:
    from .asr import stub_segments

    window = int(config.get("window_ms", 5000))
    return lambda assets: stub_segments(assets, F.coalesce("duration_ms", F.lit(3000).cast("bigint")), F.lit(window).cast("bigint"), F.col("language"), "asset_id")


@segmenters.register("grid")
def _grid(config: dict) -> Callable:
    from .intervals import grid_spans

    window = int(config.get("window_ms", 30_000))
    return lambda assets: grid_spans(assets, F.col("duration_ms"), F.lit(window).cast("bigint"))


def strip_fences(text: str) -> str:
    return re.sub(r"\s*```\s*\Z", "", re.sub(r"\A\s*```[a-zA-Z]*\s*", "", text)).strip()


def parse_translations(content: str, n: int) -> tuple[list[str] | None, str | None]:
    """Exactly n strings from a JSON array, or from an object whose only value is one; else a reason."""
    try:
        got = json.loads(strip_fences(content))
    except ValueError:
        return None, "unparseable model output"
    if isinstance(got, dict) and len(got) == 1:
        got = next(iter(got.values()))
    if isinstance(got, list) and len(got) == n and all(isinstance(x, str) for x in got):
        return got, None
    return None, "model returned wrong shape/length"


def translate_repairing(run: Callable[[list[str]], tuple[list[str] | None, str | None, bool]], texts: list[str]) -> tuple[list[str] | None, str | None, bool]:
    """Asks again once after a reply that can be repaired, then halves the batch down to single texts."""
    if not texts:
        return [], None, False
    for _ in range(2):
        ok, error, repairable = run(texts)
        if ok is not None or not repairable:
            return ok, error, repairable
    if len(texts) == 1:
        return ok, error, repairable
    half = len(texts) // 2
    out: list[str] = []
    for part in (texts[:half], texts[half:]):
        ok, error, repairable = translate_repairing(run, part)
        if ok is None:
            return ok, error, repairable
        out += ok
    return out, None, False


def chat_request(texts: list[str], before: list[str], after: list[str], config: dict) -> dict:
    task = f"Translate each string of the JSON array into {config.get('target', 'en')}. Answer with a JSON array of the same length."
    context = {"before": before, "after": after}
    return {"model": config.get("model"), "messages": [{"role": "system", "content": task}, {"role": "user", "content": json.dumps({"context": context, "texts": texts}, ensure_ascii=False)}]}


def call_with_retry(call: Callable[[dict], tuple[int, str]], request: dict, retries: int, base_ms: int) -> tuple[int, str, list[int]]:
    """Calls again on 429 and 5xx, after base * 2**attempt milliseconds; all statuses are returned."""
    statuses = []
    for attempt in range(retries + 1):
        status, body = call(request)
        statuses.append(status)
        if not (status == 429 or 500 <= status <= 599) or attempt == retries:
            break
        time.sleep(base_ms * 2**attempt / 1000.0)
    return status, body, statuses


def chat_translate(batches: DataFrame, call: Callable, config: dict) -> DataFrame:
    """Translates every batch row through a chat endpoint, with retry and repair inside the task."""
    retries, base = int(config.get("retries", 2)), int(config.get("retry_base_ms", 250))
    columns = batches.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ok, errors = [], []
            for r in frame.itertuples(index=False):
                before, after = list(r.before), list(r.after)

                def ask(texts: list[str], before=before, after=after) -> tuple[list[str] | None, str | None, bool]:
                    status, body, _ = call_with_retry(call, chat_request(texts, before, after, config), retries, base)
                    if status != 200:
                        return None, f"http {status}", False
                    got, reason = parse_translations(json.loads(body)["choices"][0]["message"]["content"], len(texts))
                    return got, reason, got is None

                got, reason, _ = translate_repairing(ask, list(r.texts))
                ok.append(got)
                errors.append(None if got is not None else f"translation-failed: {reason}")
            yield frame.assign(ok=ok, error=errors)[[*columns, "ok", "error"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batches.schema) + ", ok array<string>, error string"
    return batches.mapInPandas(run, schema)


def chunk_fallback(primary: Callable, fallback: Callable) -> Callable:
    """Batches that fail with the first translator are given to the second."""

    def run(batches: DataFrame) -> DataFrame:
        first = primary(batches)
        failed = first.where("error IS NOT NULL").drop("ok", "error")
        return first.where("error IS NULL").unionByName(fallback(failed))

    return run


def augment(translator: Callable, **columns) -> Callable:
    """A translator whose batches carry further columns of options."""
    return lambda batches: translator(batches.withColumns({k: F.lit(v) for k, v in columns.items()}))


def with_middleware(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for s in steps:
        df = df.transform(s)
    return df


def load_addons(specs: list[str]) -> dict[str, str]:
    """Imports modules that register backends; failures are recorded, not raised."""
    out = {}
    for s in dict.fromkeys(specs):
        module, _, name = s.partition(":")
        try:
            loaded = importlib.import_module(module)
            (getattr(loaded, name or "register_adapters", lambda: None))()
            out[s] = "ok"
        except Exception as e:  # noqa: BLE001
            out[s] = f"failed: {e}"
    return out


def resolve_config(overrides: dict, environ: dict, file: dict, defaults: dict) -> dict:
    """Each field from the job, else the environment (``CUELOOM_<FIELD>``), else the file, else the default."""
    pick = lambda k: next((v for v in (overrides.get(k), environ.get(f"CUELOOM_{k.upper()}"), file.get(k)) if v not in (None, "")), defaults.get(k))
    return {k: pick(k) for k in {*defaults, *overrides, *file}}

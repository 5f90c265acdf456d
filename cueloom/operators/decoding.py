"""From what speech models give to segments: responses, chunks of samples, spans, token loops and byte-level tokens."""

from __future__ import annotations

import concurrent.futures as cf
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import sample_range, strip

_RESPONSE = "struct<text:string,segments:array<struct<start:double,end:double,text:string,language:string,confidence:double>>>"


def response_segments(df: DataFrame, status: Column, body: Column, duration_ms: Column, *key: str) -> DataFrame:
    """Hypotheses (key..., pos, start, end, text, confidence, language, error) of a recogniser's replies, times in seconds.

    A reply without segments is one hypothesis over the whole clip. A status beyond 2xx, or
    a body that is no JSON object, gives one row with an error.
    """
    read = df.select(*key, duration_ms.alias("__ms"), F.coalesce(status.between(200, 299), F.lit(False)).alias("__ok"), F.from_json(body, _RESPONSE).alias("__r"), body.alias("__body"))
    bad = ~F.col("__ok") | ~F.coalesce(F.col("__body").rlike(r"^\s*\{"), F.lit(False)) | F.col("__r").isNull()
    whole = F.array(
        F.struct(F.lit(0.0).alias("start"), (F.coalesce("__ms", F.lit(0)) / 1000.0).alias("end"), F.col("__r.text").alias("text"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"))
    )
    found = F.when(bad, F.array(F.lit(None).cast("struct<start:double,end:double,text:string,language:string,confidence:double>"))).when(F.size("__r.segments") > 0, F.col("__r.segments")).otherwise(whole)
    rows = read.select(*key, F.when(bad, "asr-failed").alias("error"), F.posexplode(found).alias("pos", "x"))
    return rows.select(*key, F.col("pos").cast("bigint").alias("pos"), "x.start", "x.end", "x.text", "x.confidence", "x.language", "error")


def sample_chunks(df: DataFrame, n_samples: Column, rate: int, *key: str, seconds: int = 30) -> DataFrame:
    """(key..., chunk, offset, size): a clip in chunks of so many seconds, an empty clip as one empty chunk."""
    step, n = rate * seconds, n_samples.cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), n) - 1, F.lit(step).cast("bigint"))
    rows = df.select(*key, n.alias("__n"), F.posexplode(starts).alias("chunk", "offset"))
    return rows.select(*key, F.col("chunk").cast("bigint").alias("chunk"), "offset", F.least(F.lit(step).cast("bigint"), F.col("__n") - F.col("offset")).alias("size"))


def offset_segments(df: DataFrame, offset: Column, *columns: str) -> DataFrame:
    """Times of a part of a clip as times of the clip; those that are null stay so."""
    return df.withColumns({c: F.col(c) + offset for c in columns or ("start_ms", "end_ms")})


def span_slices(clips: DataFrame, spans: DataFrame, rate: int, pad_ms: int, *key: str) -> DataFrame:
    """(key..., pos, first, last, offset_ms, language): the samples to recognise of each clip.

    ``clips(key..., n_samples, language)``; ``spans(key..., pos, start_ms, end_ms, language)``,
    whose own language goes before the clip's. Spans without samples are left out; a clip
    without any span is recognised as a whole.
    """
    own = spans.withColumnRenamed("language", "__language").withColumn("__spanned", F.lit(True))
    joined = clips.join(own, list(key), "left")
    first, last = sample_range(F.col("start_ms"), F.col("end_ms"), pad_ms, rate, F.col("n_samples").cast("bigint"))
    ranged = joined.withColumn("first", F.when(F.col("__spanned"), first).otherwise(F.lit(0).cast("bigint")))
    ranged = ranged.withColumn("last", F.when(F.col("__spanned"), last).otherwise(F.col("n_samples").cast("bigint"))).where(F.col("__spanned").isNull() | (F.col("first") < F.col("last")))
    offset = F.floor(1000.0 * F.col("first") / rate + 0.5).cast("bigint")
    return ranged.select(*key, F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"), "first", "last", offset.alias("offset_ms"), F.coalesce("__language", "language").alias("language"))


def greedy_decode(next_token: Callable[[Column], Column], prompt: Column, end_id: int, limit: int) -> Column:
    """Tokens that follow a prompt, one after the other, until the end token or the limit.

    ``next_token`` maps the tokens so far to the next one, as an argmax over a model's
    scores would.
    """
    start = F.struct(prompt.cast("array<bigint>").alias("all"), F.lit(False).alias("done"))

    def step(a: Column, _: Column) -> Column:
        token = next_token(a["all"]).cast("bigint")
        ends = a["done"] | F.coalesce(token == end_id, F.lit(True))
        return F.struct(F.when(ends, a["all"]).otherwise(F.concat(a["all"], F.array(token))).alias("all"), ends.alias("done"))

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step, lambda a: a["all"])
    return F.slice(whole, F.size(prompt) + 1, limit)


def _byte_signs() -> list[str]:
    """The sign of each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


def byte_tokens(text: Column) -> Column:
    """One byte-level token a byte of the text."""
    signs = F.array(*map(F.lit, _byte_signs()))
    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), 1)
    return F.transform(pairs, lambda x: F.get(signs, F.conv(x, 16, 10).cast("int")))


def detokenize(tokens: Column, special: list[str]) -> Column:
    """The text of byte-level tokens, without special ones; signs that stand for no byte are left out."""
    table = F.map_from_arrays(F.array(*map(F.lit, _byte_signs())), F.array(*(F.lit(f"{b:02X}") for b in range(256))))
    plain = F.filter(tokens, lambda t: ~t.isin(*special)) if special else tokens
    signs = F.split(F.array_join(plain, ""), "")
    bytes_ = F.unhex(F.array_join(F.transform(signs, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(""))), ""))
    return strip(F.make_valid_utf8(bytes_.cast("string")))


def probe_all(df: DataFrame, probe: Callable[[str], int], timeout_s: float, *key: str, uri: str = "uri", workers: int = 4) -> DataFrame:
    """(key..., uri, value, error): every source probed on its own, ``workers`` at a time in a task.

    A probe that raises or runs out of time fails its own row only.
    """
    fields = [df.schema[c] for c in (*key, uri)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = cf.ThreadPoolExecutor(workers)
        try:
            for b in batches:
                waiting = [pool.submit(probe, u) for u in b[uri]]
                value, error = [], []
                for w in waiting:
                    try:
                        value.append(w.result(timeout=timeout_s))
                        error.append(None)
                    except cf.TimeoutError:
                        w.cancel()
                        value.append(None)
                        error.append("collect/probe-timeout")
                    except Exception:  # noqa: BLE001
                        value.append(None)
                        error.append("collect/probe-failed")
                yield b.assign(value=pd.array(value, dtype="Int64"), error=error)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", value bigint, error string"
    return df.select(*key, uri).mapInPandas(run, schema)

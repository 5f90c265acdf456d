"""Provider calls: usage, cost and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = "decimal(38,18)"


def usd_to_micros(usd: Column) -> Column:
    """Whole millionths, rounded half up."""
    return F.round(usd.cast(MICROS) * F.lit(1_000_000), 0).cast("bigint")


def normalize_usage(body: Column, input_price: Column | None = None, output_price: Column | None = None) -> Column:
    """Struct of tokens and cost from a reply's JSON, whatever names the provider gives them."""
    get = lambda *names: F.coalesce(*[F.get_json_object(body, f"$.usage.{n}") for n in names])
    whole = lambda c: c.try_cast("decimal(38,6)").cast("bigint")
    inp, out = whole(get("prompt_tokens", "input_tokens")), whole(get("completion_tokens", "output_tokens"))
    cost = F.coalesce(whole(get("cost_micros")), usd_to_micros(get("cost").try_cast(MICROS)))
    if input_price is not None and output_price is not None:
        cost = F.coalesce(cost, usd_to_micros(inp.cast("decimal(20,0)") * input_price.cast("decimal(18,12)") + out.cast("decimal(20,0)") * output_price.cast("decimal(18,12)")))
    return F.struct(inp.alias("input_tokens"), out.alias("output_tokens"), F.coalesce(whole(get("total_tokens")), inp + out).alias("total_tokens"), cost.alias("cost_micros"))


def usage_rollup(attempts: DataFrame, *by: str) -> DataFrame:
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    return attempts.groupBy(*by).agg(total("input_tokens"), total("output_tokens"), total("total_tokens"), total("cost_micros"), F.count("*").alias("attempts"))


def number_attempts(attempts: DataFrame, order: list[str], *job: str) -> DataFrame:
    return attempts.withColumn("attempt", F.row_number().over(Window.partitionBy(*job).orderBy(*order)).cast("bigint"))


def attach(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """Results, good or failed, with their attempts in order and their usage."""
    fields = [c for c in attempts.columns if c != "job_id"]
    own = attempts.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("attempt", *[c for c in fields if c != "attempt"]))).alias("attempts"))
    return results.join(own, "job_id", "left").join(usage_rollup(attempts, "job_id").drop("attempts"), "job_id", "left")


def retry_delay(base: Column | int, attempt: Column) -> Column:
    return ((F.lit(base) if isinstance(base, int) else base) * F.pow(F.lit(2.0), attempt)).cast("bigint")

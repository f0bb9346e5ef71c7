"""Totals of a run log: tokens, spend and speed by session; and lines of text searched and numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"
#: Seconds of a reply below which its speed says nothing.
LEAST_WINDOW = 0.05


def priced(prompt: Column, completion: Column, cached: Column, prompt_price: Column, completion_price: Column, cached_price: Column) -> Column:
    """Spend by a catalog's prices for a token; null where a price is unknown."""
    dec = lambda c: c.cast("decimal(18,12)")
    count = lambda c: c.cast("decimal(18,0)")
    cheap = F.coalesce(cached_price, prompt_price)
    return (count(prompt - cached) * dec(prompt_price) + count(cached) * dec(cheap) + count(completion) * dec(completion_price)).cast(DECIMAL)


def session_totals(calls: DataFrame) -> DataFrame:
    """One row a session of calls (session, seq, prompt, completion, cost, estimate, seconds).

    A call's own cost is known; else its estimate stands in, and the total is marked; a call with tokens but neither
    makes the spend unknown. The speed is that of the last call that took long enough to tell."""
    speed = F.when(F.col("seconds") > LEAST_WINDOW, F.col("completion") / F.col("seconds"))
    used = (F.col("prompt") > 0) | (F.col("completion") > 0)
    unpriced = F.col("cost").isNull() & F.col("estimate").isNull() & used
    return calls.groupBy("session").agg(
        F.count("*").alias("calls"),
        F.sum("prompt").alias("prompt"),
        F.sum("completion").alias("completion"),
        F.max_by("prompt", "seq").alias("context"),
        F.sum(F.coalesce("cost", "estimate").cast(DECIMAL)).alias("spend"),
        (~F.bool_or(unpriced)).alias("spend_known"),
        F.bool_or(F.col("cost").isNull() & F.col("estimate").isNotNull() & used).alias("estimated"),
        F.max_by(speed, F.when(speed.isNotNull(), F.col("seq"))).alias("tokens_per_second"),
    )


def recent(calls: DataFrame, label: Column, n: int = 8) -> DataFrame:
    """The labels of a session's last n calls, in order. Of each session only n labels are gathered."""
    nth = F.row_number().over(W.partitionBy("session").orderBy(F.col("seq").desc()))
    last = calls.select("session", "seq", label.alias("label")).withColumn("nth", nth).filter(F.col("nth") <= n)
    return last.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda x: x["label"]).alias("labels"))


def context_tokens(messages: DataFrame) -> DataFrame:
    """tokens of each session's messages: characters by four, cut."""
    return messages.groupBy("session").agg(F.floor(F.sum(F.length("text")) / 4).alias("tokens"))


def context_groups(messages: DataFrame) -> DataFrame:
    """messages with grp: an assistant's message and the results that follow it are one group, any other its own."""
    order = W.partitionBy("session").orderBy("seq")
    starts = F.when((F.col("role") != "tool") | F.lag("role").over(order).isNull(), 1).otherwise(0)
    return messages.withColumn("_s", starts).withColumn("grp", F.sum("_s").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def grep(files: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, name_glob: str | None = None, most: int | None = 200) -> DataFrame:
    """path, line_no, line of lines that match, in order, `most` of them at most (None: all). Files with a NUL are skipped.

    files: path, text."""
    rows = files.filter(~F.contains("text", F.lit("\x00")))
    if name_glob:
        rows = rows.filter(F.regexp_extract("path", r"([^/]*)$", 1).rlike(glob_regex(name_glob)))
    if fixed:
        line, wanted = (F.lower("line"), pattern.lower()) if ignore_case else (F.col("line"), pattern)
        hit = F.contains(line, F.lit(wanted))
    else:
        hit = F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)
    found = lines(rows).filter(hit)
    return found if most is None else found.orderBy("path", "line_no").limit(most)


def glob_regex(glob: str) -> str:
    """A file-name pattern of *, ? and [sets] as a regular expression."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        close = glob.find("]", at + 2) if c == "[" else -1
        if close > 0:
            inner = glob[at + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            at = close
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c
        at += 1
    return f"^{out}$"


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), line."""
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def line_range(files: DataFrame, start: int, stop: int) -> DataFrame:
    """Lines start to stop of each file, without making rows of the others."""
    own = F.slice(F.split("text", "\n", -1), start, stop - start + 1)
    return files.select("path", F.posexplode(own).alias("i", "line")).select("path", (F.col("i") + start).alias("line_no"), "line")


def listed(files: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """path, hidden: the first paths that fit a pattern, and how many more there are."""
    hits = files.filter(F.col("path").rlike(glob_regex(pattern))).select("path")
    n = hits.agg(F.count("*").alias("n"))
    # One row of a count beside a bounded list.
    return hits.orderBy("path").limit(most).crossJoin(F.broadcast(n)).select("path", F.greatest(F.col("n") - most, F.lit(0)).alias("hidden"))

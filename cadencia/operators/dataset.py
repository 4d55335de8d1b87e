"""Fine-tuning conversation sets: validation, cleaning with reasons, deduplication, topics, splits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencia.functions import text as tx
from cadencia.operators.lookups import first_share

#: Topics in the order in which ties are won, with their keywords; a caller can give others.
TOPICS = {
    "orders": ("order", "price", "buy", "cart", "طلب", "شراء"),
    "account": ("login", "password", "account", "auth", "تسجيل", "حساب"),
    "reminders": ("reminder", "predict", "model", "تذكير"),
    "analytics": ("dashboard", "report", "rate", "churn", "تقرير"),
    "automation": ("workflow", "webhook", "email", "رسالة"),
    "rules": ("policy", "privacy", "audit", "مراجعة"),
}
GENERIC = ("as an ai language model",)


def conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: messages in turn order."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))


def role_text(role: str, sep: str = " ") -> Column:
    return F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == role), lambda m: m["content"]), sep)


def all_text(without_system: bool = False) -> Column:
    picked = F.filter("messages", lambda m: m["role"] != "system") if without_system else F.col("messages")
    return F.array_join(F.transform(picked, lambda m: m["content"]), " ")


def validate(convs: DataFrame, least: int = 3) -> DataFrame:
    """valid: enough messages, the first from the system, none empty."""
    empty = F.exists("messages", lambda m: m["content"].isNull() | (F.trim(m["content"]) == ""))
    return convs.withColumn("n_messages", F.size("messages")).withColumn("valid", (F.size("messages") >= least) & (F.col("messages")[0]["role"] == "system") & ~empty)


def first_reason(convs: DataFrame, expected_prompt: str | None = None, close_words: tuple[str, ...] = (), generic: tuple[str, ...] = GENERIC, least: int = 3) -> DataFrame:
    """convs with reason (null: kept): the first failing check in a fixed order.

    Only conversations that pass all checks before it take part in the duplicate check, and a generic one does not claim its
    fingerprint, so the first one that is not generic stays and both kinds of later copies are named.
    """
    size, head, tail = F.size("messages"), F.col("messages")[0], F.element_at("messages", -1)
    empty = F.exists("messages", lambda m: m["role"].isNull() | m["content"].isNull() | (F.trim(m["content"]) == ""))
    wrong = F.lit(False)
    if expected_prompt is not None:
        close = F.lit(bool(close_words))
        for w in close_words:
            close = close & F.contains(head["content"], F.lit(w))
        wrong = (F.trim(head["content"]) != expected_prompt) & ~close
    reason = F.when(F.col("messages").isNull(), "format").when(size < least, "too_short").when(head["role"] != "system", "no_system").when(wrong, "wrong_system").when(empty, "empty_message").when(tail["role"] != "assistant", "no_answer")
    rows = convs.withColumn("__early", reason).withColumn("__fp", tx.loose_fingerprint(role_text("user"))).withColumn("__generic", tx.contains_any(F.lower(role_text("assistant")), generic))
    open_ = F.col("__early").isNull()
    claims = F.when(open_ & ~F.col("__generic"), F.col("conv_id"))
    first = rows.groupBy("__fp").agg(F.min(claims).alias("__first"))
    joined = rows.join(first, "__fp")
    duplicate = open_ & F.col("__first").isNotNull() & (F.col("conv_id") > F.col("__first"))
    return joined.withColumn("reason", F.coalesce("__early", F.when(duplicate, "duplicate"), F.when(F.col("__generic"), "generic"))).drop("__early", "__fp", "__generic", "__first")


def repaired(convs: DataFrame, prompt: str) -> DataFrame:
    """The system message's content replaced by the expected prompt."""
    fixed = F.transform("messages", lambda m, i: F.when((i == 0) & (m["role"] == "system"), m.withField("content", F.lit(prompt))).otherwise(m))
    return convs.withColumn("messages", fixed)


def keep_first(rows: DataFrame, key: Column, position: str) -> DataFrame:
    """The first row of each key by position: the least position of each key, then a join, so no key is sorted whole."""
    keyed = rows.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min(position).alias(position))
    return keyed.join(first, ["__key", position], "left_semi").drop("__key")


def topic(rows: DataFrame, text: Column, topics: dict[str, tuple[str, ...]] = TOPICS, occurrences: bool = False, default: str = "general") -> DataFrame:
    """The topic with most keywords present (or most occurrences); the first of equals; default without any."""
    low = F.lower(text)
    count = lambda k: ((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("int") if occurrences else F.contains(low, F.lit(k)).cast("int")
    scores = [sum((count(k) for k in words), F.lit(0)) for words in topics.values()]
    best = F.greatest(*scores)
    picked = F.lit(default)
    for name, score in reversed(list(zip(topics, scores, strict=True))):
        picked = F.when(score == best, F.lit(name)).otherwise(picked)
    return rows.withColumn("topic", F.when(best > 0, picked).otherwise(F.lit(default)))


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """split: `train` for floor(share * n) rows of each stratum in hash order, else `validation`."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    split = first_share(rows, stratum, digest, (key,), share, "split")
    return split.withColumn("split", F.when(F.col("split"), "train").otherwise("validation"))


def set_statistics(rows: DataFrame, length: Column) -> DataFrame:
    """Count, mean, ends, upper median (sorted[n // 2]) and total."""
    from cadencia.operators.kpi import nearest_rank

    sized = rows.select(length.cast("long").alias("v"))
    row = sized.agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"))
    return row.crossJoin(nearest_rank(sized, "v", [0.5]).select(F.col("p50").alias("upper_median")))


def score_ten(n: Column, arabic: Column, english: Column, topics: Column, duplicate_pct: Column) -> Column:
    balance = F.least(arabic, english) / F.greatest(n, F.lit(1)) * 2
    return F.round((balance * 0.25 + F.least(F.lit(1.0), topics / 10) * 0.25 + F.least(F.lit(1.0), n / 10000) * 0.30 + F.greatest(F.lit(0.0), 1 - duplicate_pct / 100) * 0.20) * 10, 4)


def score_hundred(n: Column, arabic_pct: Column, removed: Column, topics: Column) -> Column:
    off = lambda cond, points: F.when(cond, points).otherwise(0)
    return 100 - off(F.abs(arabic_pct - 50) > 15, 10) - off(removed > n * 5, 10) - off(n < 1000, 20) - off(topics < 5, 15)


def quality_report(convs: DataFrame, topics: dict[str, tuple[str, ...]] = TOPICS) -> DataFrame:
    """One row on a conversation set: sizes, languages, topics, duplicates and both scores."""
    reasons = first_reason(convs)
    kept = topic(reasons.filter(F.col("reason").isNull()), all_text(True), topics).withColumn("language", tx.script_language(all_text(), "English"))
    kept_row = kept.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("messages"), F.count_if(F.col("language") == "Arabic").alias("arabic"),
        F.count_if(F.col("language") == "English").alias("english"), F.countDistinct("topic").alias("topics"), F.coalesce(F.sum(tx.token_estimate(all_text())), F.lit(0)).alias("tokens"),
    )
    gone = reasons.agg(F.count_if(F.col("reason").isNotNull()).alias("removed"), F.count_if(F.col("reason") == "duplicate").alias("duplicates"), F.count(F.lit(1)).alias("total"))
    row = kept_row.crossJoin(gone)
    pct = F.col("arabic") * 100 / F.greatest("n", F.lit(1))
    return row.withColumn("score_ten", score_ten(F.col("n"), F.col("arabic"), F.col("english"), F.col("topics"), F.col("duplicates") * 100 / F.greatest("total", F.lit(1)))).withColumn("score_hundred", score_hundred(F.col("n"), pct, F.col("removed"), F.col("topics")))


def chat_template(convs: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Each conversation as one training text."""
    one = lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), m["content"], F.lit(end))
    return convs.withColumn("rendered", F.array_join(F.transform("messages", one), "\n"))

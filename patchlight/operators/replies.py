"""Model replies as columns, prompts, and the slot for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlight import constants as C
from patchlight.functions import columns as X

TEXT_FIELDS = ["file", "title", "description", "severity", "category", "impact_type", "impact_statement", "diff_snippet", "evidence_source"]
NUMBER_FIELDS = ["confidence", "token_cost"]
THINK = r"(?s)<think>(.*?)</think>"


def thinking(reply: Column) -> Column:
    return X.python_strip(F.regexp_extract(reply, THINK, 1))


def result_part(reply: Column) -> Column:
    """Text after the first closed thinking block; the whole reply without one."""
    return X.python_strip(F.when(reply.rlike(THINK), F.regexp_replace(reply, r"(?s)^.*?<think>.*?</think>", "")).otherwise(reply))


def outer_object(text: Column) -> Column:
    """The JSON value in a reply: the text from the first bracket of either kind to the last of the same kind."""
    # A list counts only where items can follow, so that a note such as [1] in the words before hides nothing.
    opened = F.regexp_extract(text, r"(?s)^.*?(\{|\[(?=\s*[\{\]\"]))", 1)
    listed = F.regexp_extract(text, r"(?s)(\[\s*[\{\]\"].*\]|\[\s*\])", 1)
    cut = F.when(opened == "[", listed).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.when(cut != "", cut).otherwise(text)


def parse_reviews(replies: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(status rows, finding rows) of reviewer replies.

    The findings are the list itself or the object's "findings". Items are read one by one: numbers may be written as text, and an item
    that is no object, lacks a required field or holds a number that cannot be read is dropped alone.
    """
    keys = [c for c in replies.columns if c != reply]
    body = replies.select(*keys, F.col(reply), outer_object(result_part(F.col(reply))).alias("_j"))
    body = body.withColumn("_v", F.try_parse_json("_j"))
    ok = F.col("_v").isNotNull()
    status = body.select(
        *keys, F.when(ok, "success").otherwise("format_error").alias("status"), thinking(F.col(reply)).alias("thinking"))
    found = F.coalesce(F.try_variant_get("_v", "$.findings", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"))
    items = body.where(ok).select(*keys, F.posexplode(found).alias("ord", "f"))
    text = {c: F.try_variant_get("f", f"$.{c}", "string") for c in [*TEXT_FIELDS, *NUMBER_FIELDS, "line"]}
    number = {c: F.expr(f"try_cast(_{c} AS double)") for c in [*NUMBER_FIELDS, "line"]}
    read = items.select(*keys, "ord", *[text[c].alias(c) for c in TEXT_FIELDS], *[text[c].alias(f"_{c}") for c in number],
                        F.try_variant_get("f", "$.evidence", "array<string>").alias("evidence"))
    sound = F.col("confidence").isNotNull()
    for c in ("file", "title", "description", "severity", "category"):
        sound = sound & F.col(c).isNotNull()
    whole_line = F.col("_line").isNull() | (F.col("line") == F.floor("line"))
    rows = read.select(*keys, "ord", *TEXT_FIELDS, "evidence", "_line", *[number[c].alias(c) for c in number]).where(sound & F.coalesce(whole_line, F.lit(False)))
    rows = rows.select(
        *keys, "ord", "file", F.col("line").cast("int").alias("line"), "title", "description", "severity", "confidence", "category", "impact_type", "impact_statement",
        "diff_snippet", "evidence", F.coalesce("evidence_source", F.lit("DIFF")).alias("evidence_source"), F.coalesce("token_cost", F.lit(0.0)).alias("token_cost"))
    return status, rows


def extract_json(reply: Column) -> Column:
    """Content of the first fenced block, else the text."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    return F.when(reply.rlike(fence), X.python_strip(F.regexp_extract(reply, fence, 1))).otherwise(X.python_strip(reply))


def keep_indices(reply: Column) -> Column:
    """keep_index values of the array in a reply; null when there is none, which keeps all."""
    arr = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<keep_index:int>>")
    kept = F.filter(F.transform(arr, lambda g: g["keep_index"]), lambda i: i.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def parse_baseline(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Array replies as comments with High, Medium or Low."""
    keys = [c for c in replies.columns if c != reply]
    arr = F.from_json(extract_json(F.col(reply)), "array<struct<line:int,severity:string,title:string,description:string>>")
    sev = F.lower(F.coalesce("o.severity", F.lit("medium")))
    level = F.when(sev.isin("high", "error"), "High").when(sev.isin("low", "info"), "Low").otherwise("Medium")
    return replies.select(*keys, F.posexplode(arr).alias("ord", "o")).where("o is not null").select(
        *keys, "ord", F.col("o.line").alias("line"),
        F.concat(F.lit("["), level, F.lit("] "), F.coalesce("o.title", F.lit("")), F.lit("\n\n"), F.coalesce("o.description", F.lit(""))).alias("body"))


def confirmed(issues: DataFrame, replies: DataFrame) -> DataFrame:
    """Issues (pr_id, idx from 1) a verdict reply confirms; all when it confirms none or cannot be read."""
    arr = F.from_json(extract_json(F.col("reply")), "array<struct<index:int,verdict:string>>")
    yes = F.transform(F.filter(arr, lambda v: v["verdict"] == "CONFIRM"), lambda v: v["index"])
    verdicts = replies.select("pr_id", yes.alias("_yes"))
    joined = issues.join(verdicts, "pr_id", "left")
    keep_all = F.coalesce(F.size("_yes"), F.lit(0)) <= 0
    return joined.where(keep_all | F.array_contains("_yes", F.col("idx"))).select(*issues.columns)


def prompts(prs: DataFrame, perspective: Column, symbols: DataFrame | None = None) -> DataFrame:
    """System and user prompt columns per change. symbols: pr_id, ord, snippet; the first five are shown."""
    base = prs
    shown = F.lit("")
    if symbols is not None:
        few = symbols.where("ord < 5").groupBy("pr_id").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "snippet"))), lambda s: s["snippet"]), "\n").alias("_defs"))
        base = prs.join(few, "pr_id", "left")
        shown = F.coalesce("_defs", F.lit(""))
    names = F.slice("files", 1, 20)
    user = F.concat_ws(
        "\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Description: "), F.left(F.coalesce("description", F.lit("")), F.lit(500))),
        F.concat(F.lit("Files: "), F.array_join(names, ", ")), F.when(shown != "", F.concat(F.lit("Definitions:\n"), shown)),
        F.lit("Diff:"), F.left("diff", F.lit(40000)))
    return base.select("pr_id", system_prompt(perspective).alias("system"), user.alias("prompt"))


PERSPECTIVES = {
    "default": "Review the change for defects that matter at run time.",
    "security": "Review the change for security defects only.",
    "performance": "Review the change for performance defects only.",
    "maintainability": "Review the change for maintainability only.",
}


def system_prompt(perspective: Column) -> Column:
    return X.lookup(perspective, PERSPECTIVES, PERSPECTIVES["default"])


def perspective(review_type: Column, asked: Column) -> Column:
    return X.lookup(review_type, {"all": "default", "bugs": "default", "security": "security", "performance": "performance"}, asked)


Model = Callable[[pd.DataFrame], pd.Series]


def rule_model(batch: pd.DataFrame) -> pd.Series:
    """Offline stand-in: flags eval and bare except on added lines. One reply per prompt."""
    def reply(prompt: str) -> str:
        found = []
        for row in prompt.splitlines():
            if row.startswith("+") and "eval(" in row:
                found.append('{"file":"","title":"eval of input","description":"eval runs its text","severity":"ERROR","confidence":0.9,"category":"security"}')
            elif row.startswith("+") and row.strip("+ ") == "except:":
                found.append('{"file":"","title":"bare except","description":"hides errors","severity":"WARNING","confidence":0.8,"category":"quality"}')
        return '{"findings":[' + ",".join(found) + "]}"

    return batch["prompt"].map(reply)


def run_reviewers(prompted: DataFrame, model: Model = rule_model, max_tokens: int = C.MAX_TOKENS_PER_CALL) -> DataFrame:
    """Replies of a model on prompt batches (Arrow). Prompts over the token limit get an error row instead.

    prompted: pr_id, system, prompt. Returns pr_id, reply, tokens, error.
    """
    sized = prompted.withColumn("tokens", X.tokens(F.col("prompt")))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"pr_id": b["pr_id"], "reply": model(b), "tokens": b["tokens"]})

    called = sized.where(F.col("tokens") <= max_tokens).mapInPandas(call, "pr_id bigint, reply string, tokens bigint")
    refused = sized.where(F.col("tokens") > max_tokens).select(
        "pr_id", F.lit(None).cast("string").alias("reply"), F.lit(0).cast("bigint").alias("tokens"),
        F.concat(F.lit("Budget exceeded: "), F.col("tokens").cast("string"), F.lit(f" > {max_tokens}")).alias("error"))
    return called.withColumn("error", F.lit(None).cast("string")).unionByName(refused)

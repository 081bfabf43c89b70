"""Texts handed to models and answers read back."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.basics import blank_to_null, leading, strip

# Search queries that are no real query, and stand-ins for missing parts.
PSEUDO_QUERIES = ("force_url", "manual", "website", "n/a", "none", "未知")
NO_KEYWORDS = "（未配置业务关键词，仅判断是否为招标/采购阶段公告）"
NO_TITLE = "无标题"
NO_CONTENT = "无内容"
FENCE = "```"

NOTICE_LABELS = ("招标", "中标", "变更公告", "废标公告", "采购意向", "预招标", "合同", "验收公告", "其他")


def model_input(title: Column, text: Column, limit: int | None = None) -> Column:
    """``title [SEP] text``, or the text alone."""
    body = leading(F.coalesce(text, F.lit("")), limit)
    return F.when(
        F.coalesce(F.length(title), F.lit(0)) > 0, F.concat(title, F.lit(" [SEP] "), body)
    ).otherwise(body)


def training_input(title: Column, text: Column, limit: int | None = None) -> Column:
    """As ``model_input`` on trimmed parts; the title alone if there is no text, NULL if neither."""
    head = blank_to_null(strip(title))
    body = blank_to_null(leading(strip(text), limit))
    return F.when(body.isNull(), head).otherwise(
        F.concat(F.coalesce(head, F.lit("")), F.lit(" [SEP] "), body)
    )


def notice_label(notice_type: Column, labels: tuple[str, ...] = NOTICE_LABELS) -> Column:
    """Known type, or the catch-all last label."""
    return F.when(notice_type.isin(*labels), notice_type).when(
        notice_type.isNotNull(), F.lit(labels[-1])
    )


def prompt(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places; places without a value stay as they are."""
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values.get(name, F.lit("{" + name + "}")))
    return F.concat(*parts) if parts else F.lit("")


def labelling_prompt(
    template: str, title: Column, content: Column, search_query: Column, keywords: list[str],
    limit: int | None = None,
) -> Column:
    sought = strip(F.coalesce(search_query, F.lit("")))
    real = (sought != "") & ~F.lower(sought).isin(*PSEUDO_QUERIES)
    return prompt(
        template,
        business_keywords=F.lit("、".join(keywords) if keywords else NO_KEYWORDS),
        search_query=F.when(real, sought).otherwise(F.lit("N/A")),
        title=F.coalesce(blank_to_null(title), F.lit(NO_TITLE)),
        content=F.coalesce(blank_to_null(leading(content, limit)), F.lit(NO_CONTENT)),
    )


def read_reply(reply: Column) -> Column:
    """Struct (label, reason) of a model's JSON reply; NULL unless the label is 0 or 1."""
    text = strip(reply)
    body = F.regexp_replace(F.regexp_replace(text, r"\A[^\n]*\n", ""), r"(?s)```(?!.*```).*\z", "")
    json = F.when(F.startswith(text, F.lit(FENCE)), strip(body)).otherwise(text)
    parsed = F.from_json(json, "label string, reason string")
    number = F.when(F.lower(parsed["label"]) == "true", F.lit(1)).when(
        F.lower(parsed["label"]) == "false", F.lit(0)
    ).otherwise(parsed["label"].try_cast("double").try_cast("int"))
    return F.when(
        number.isin(0, 1),
        F.struct(number.alias("label"), F.coalesce(parsed["reason"], F.lit("")).alias("reason")),
    )

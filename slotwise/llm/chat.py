"""Chat formatting with Spark expressions only.

Turns are placed by a window, collected as structs and sorted; adjacent turns of one role become a block by array
functions; blocks are concatenated with the marks of a template. Roles and texts are escaped, so that no mark or
reserved control string of theirs can be taken for one of the template: every backslash is doubled, and a backslash
goes behind the first character of each control string. `read_back` parses the formatted text alone.

A conversation is one row of the result, so it has to fit in a row; all steps are linear in its length. Rows go by
turn, equal turns by role and text; a null role or text is empty; rows of a null conv_id are one conversation;
repeated rows are turns of their own; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared


@dataclass(frozen=True)
class Template:
    """Marks: a block is opening, role, head, its texts with `joint` between them, and close. Texts of `learn` are learnt."""

    opening: str = "<|turn|>"
    head: str = "<|text|>"
    joint: str = "<|next|>"
    close: str = "<|end|>"
    learn: str = "assistant"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.opening, self.head, self.joint, self.close, *self.reserved)

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c for c in self.controls) or len(set(self.controls)) < len(self.controls):
            raise ValueError("control strings differ, have two characters at least and no backslash")
        marks = self.controls[:4]
        if any(a[-n:] == b[:n] for a in marks for b in marks for n in range(1, min(len(a), len(b)) + 1) if a != b or n < len(a)):
            raise ValueError("no mark may begin as one ends, or a text's end and a mark could be read as another mark")

    def escape(self, text: Column) -> Column:
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(text, rf"(\\|{starts})", r"$1\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, and loss: the (start, chars) of each learnt text in `formatted`, code points from 1."""
    prepared(turns.sparkSession)
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), template.escape(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = clean.withColumn("at", F.row_number().over(order)).withColumn("prior", F.lag("role").over(order))
    fresh = F.col("prior").isNull() | (F.col("prior") != F.col("role"))
    name = template.escape(F.col("role"))
    opened = F.length(name) + len(template.opening) + len(template.head) + F.when(F.col("prior").isNull(), 0).otherwise(len(template.close))
    lead = F.when(fresh, opened).otherwise(len(template.joint))
    end = F.sum((lead + F.length("text")).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = before.select("conv_id", F.struct("at", "role", name.alias("name"), "text", (end - F.length("text") + 1).alias("start"), F.length("text").alias("chars")).alias("t"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    at = lambda i: F.element_at("turns", i)
    first = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (at(i)["role"] != at(F.greatest(i - 1, F.lit(1)))["role"]))
    cut = grouped.withColumn("first", first)
    last = lambda k: F.coalesce(F.get("first", k + 1), F.size("turns") + 1)
    texts = lambda i, k: F.array_join(F.transform(F.slice("turns", i, last(k) - i), lambda t: t["text"]), template.joint)
    blocks = F.transform("first", lambda i, k: F.concat(F.lit(template.opening), at(i)["name"], F.lit(template.head), texts(i, k), F.lit(template.close)))
    loss = F.transform(F.filter("turns", lambda t: t["role"] == template.learn), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars")))
    return cut.select("conv_id", F.array_join(blocks, "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role and text of each, in order) and learnt (the texts under the loss mask), from the formatted text."""
    parts = lambda text, mark: F.split(text, re.escape(mark), -1)
    blocks = F.filter(parts(F.col("formatted"), template.close), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = template.unescape(F.substring(F.get(parts(block, template.head), F.lit(0)), len(template.opening) + 1, 2**31 - 1))
        texts = parts(F.get(parts(block, template.head), F.lit(1)), template.joint)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), template.unescape(t).alias("text")))

    learnt = F.transform("loss", lambda s: template.unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["chars"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), learnt.alias("learnt"))


def digests(back: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt, sha = F.array_join("learnt", ""), lambda c: F.sha2(c.cast("binary"), 256)
    long = lambda c: c.cast("bigint")
    return back.select("conv_id", long(F.size("turns")).alias("n_turns"), sha(said).alias("turns_sha256"), long(F.length(learnt)).alias("loss_chars"), sha(learnt).alias("loss_sha256"), long(F.length("formatted")).alias("formatted_chars"))

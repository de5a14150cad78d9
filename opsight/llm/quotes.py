"""Conversations from messages that quote each other.

A message is split by quote level: lines without a mark are its own words, lines behind one
``>`` are those of the message it answers, and so on. Quoted passages and own passages (the
whole, every run of lines and every line, in that order of weight) are normalised and
hashed, and passages meet their originals by hash: within a scope, such as one mailing list
or channel, the original is the last earlier message with the passage. A passage that its
scope does not have is looked up everywhere and counts only if exactly one message there
has it, so a phrase that everybody writes links nobody.

A message answers the message its lowest quote level points to; on one level, the one most
quoted words belong to. Roots and depths of the replies come from pointer jumping, in as
many rounds as the longest chain has binary digits. What a passage has in common with
others never multiplies rows: originals are found by a running window per scope and
passage, or by a count per passage that map tasks combine.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsight.scratch import materialize

_LINE = re.compile(r"\r\n|\r|\n")
_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
# How mail programs introduce a quote in four languages.
_INTRODUCTION = re.compile(r"\b(?:wrote|writes|schrieb|a écrit|escribió)\b.*:\s*$")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST_WORDS = 3


def parse(text: str) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """Own lines, and the runs of quoted lines with their levels (from 1)."""
    lines: list[tuple[int, str]] = []
    for line in _LINE.split(text):
        mark = _MARK.match(line)
        lines.append((mark.group(1).count(">"), line[mark.end() :]) if mark else (0, line))
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    last = 0
    following = [0] * len(lines)  # level of the next line that is quoted otherwise or not blank
    for i in range(len(lines) - 2, -1, -1):
        level, line = lines[i + 1]
        following[i] = level if level != lines[i][0] or line.strip() else following[i + 1]
    for (level, line), ahead in zip(lines, following, strict=True):
        if ahead > level and _INTRODUCTION.search(line):
            continue
        if level == 0:
            own.append(line)
        elif level == last:
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
        last = level
    return own, runs


def normalised(lines: Sequence[str]) -> str:
    return " ".join(" ".join(lines).translate(_UPPER).split())


def passages(lines: Sequence[str], whole: bool) -> dict[str, int]:
    """Normalised passages with their numbers of words: the whole, and its longer lines."""
    found = {normalised(lines): 0} if whole else {}
    for line in lines:
        found.setdefault(normalised([line]), LEAST_WORDS)
    return {t: n for t, least in found.items() if (n := len(t.split())) and n >= least}


def _hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("words", pa.int32())]))
    for batch in batches:
        own_texts, units = [], []
        for text in batch.column(1):
            own, runs = parse(text.as_py() or "")
            found = {(0, t): n for t, n in passages(own, True).items()}
            for level in {n for n, _ in runs}:
                all_lines = [line for n, lines in runs if n == level for line in lines]
                for t, n in passages(all_lines, True).items():
                    found[level, t] = n
            for level, lines in runs:
                found.setdefault((level, normalised(lines)), len(normalised(lines).split()))
            own_texts.append("\n".join(own).strip())
            units.append([{"level": n, "hash": _hash(t), "words": w} for (n, t), w in found.items() if w])
        columns = [batch.column(0), pa.array(own_texts, pa.string()), pa.array(units, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["_key", "_own", "_units"])


def _links(units: DataFrame) -> DataFrame:
    """``_key`` and ``_parent`` of messages with a quote that was found."""
    order = Window.partitionBy("_scope", "_hash").orderBy("_at", "_key", F.col("_level").desc())
    earlier = F.last(F.when(F.col("_level") == 0, F.col("_key")), ignorenulls=True)
    near = units.withColumn("_near", earlier.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    quotes = near.filter("_level > 0")
    only = units.filter("_level = 0").groupBy("_hash").agg(F.max("_key").alias("_far"), F.count(F.lit(1)).alias("_n"))
    only = only.filter("_n = 1").select("_hash", "_far")
    missing = quotes.filter("_near is null").select("_key", "_hash", "_level", "_words").join(only, "_hash")
    found = quotes.filter("_near is not null").select("_key", "_level", "_words", F.col("_near").alias("_parent"))
    found = found.unionAll(missing.select("_key", "_level", "_words", F.col("_far").alias("_parent")))
    weights = found.filter("_parent <> _key").groupBy("_key", "_level", "_parent").agg(F.sum("_words").alias("_words"))
    best = F.min(F.struct("_level", (-F.col("_words")).alias("_less"), "_parent")).alias("_best")
    return weights.groupBy("_key").agg(best).select("_key", F.col("_best._parent").alias("_parent"), F.col("_best._level").alias("_quote_level"))


def _rooted(messages: DataFrame) -> DataFrame:
    """``_key``, ``_root``, ``_depth`` by pointer jumping over ``_key``, ``_parent``.

    A round replaces the ancestor of every message that has not reached its root by the
    ancestor of that. Links may form a circle over scopes only; what is left when a round
    brings nobody to a root is a root of its own.
    """
    top = F.col("_parent").isNull()
    state = messages.select(
        "_key", F.coalesce("_parent", "_key").alias("_root"), (~top).cast("long").alias("_depth"), top.alias("_done")
    )
    state, left = materialize(state, "quotes-roots"), None
    while (n := state.filter("not _done").count()) not in (0, left):
        left = n
        above = state.select(
            F.col("_key").alias("_root"), F.col("_root").alias("_next"), F.col("_depth").alias("_more"), F.col("_done").alias("_there")
        )
        jumped = state.filter("not _done").join(above, "_root")
        jumped = jumped.select(
            "_key", F.col("_next").alias("_root"), (F.col("_depth") + F.col("_more")).alias("_depth"), F.col("_there").alias("_done")
        )
        state = materialize(state.filter("_done").unionAll(jumped), "quotes-roots")
    done = F.col("_done")
    return state.select(
        "_key", F.when(done, F.col("_root")).otherwise(F.col("_key")).alias("_root"), F.when(done, F.col("_depth")).otherwise(0).alias("_depth")
    )


def reply_threads(
    messages: DataFrame,
    key_cols: Sequence[str] = ("conv_id", "turn"),
    scope_cols: Sequence[str] = ("conv_id",),
    order_col: str = "turn",
    text_col: str = "text",
) -> DataFrame:
    """One row per message: ``message``, ``parent``, ``root`` (keys as text, joined by ``:``),
    ``depth``, ``quote_level`` (of the quote that gave the parent), ``position`` (the message's
    order) and ``text``, its own words without quotes and their introductions.

    Sorted by root, depth, position and message, a root's rows are its conversation in the
    order of replies. A null or empty text has no passage, so it neither answers nor is
    answered. A null order comes before all others, a null key part is an empty one. Rows
    with the same key are one message for linking and stay separate rows. Own passages of
    fewer than three words link only as whole messages. Other columns are not read. An
    empty table gives an empty result.
    """

    def joined(columns: Sequence[str]):
        return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])

    keyed = messages.select(
        F.struct(
            joined(key_cols).alias("key"), joined(scope_cols).alias("scope"), F.col(order_col).cast("long").alias("at")
        ).alias("_key"),
        F.col(text_col).cast("string").alias("_text"),
    )
    kinds = "_key struct<key:string,scope:string,at:bigint>, _own string, _units array<struct<level:int,hash:binary,words:int>>"
    parsed = keyed.mapInArrow(_parsed, kinds)
    parsed = parsed.select(F.col("_key.key").alias("_key"), F.col("_key.scope").alias("_scope"), F.col("_key.at").alias("_at"), "_own", "_units")
    parsed = materialize(parsed, "quotes-parsed")
    units = parsed.select("_key", "_scope", "_at", F.explode("_units").alias("_unit")).select(
        "_key", "_scope", "_at", F.col("_unit.level").alias("_level"), F.col("_unit.hash").alias("_hash"), F.col("_unit.words").alias("_words")
    )
    links = materialize(_links(units), "quotes-links")
    linked = parsed.select("_key").distinct().join(links.select("_key", "_parent"), "_key", "left")
    rooted = _rooted(linked).join(links, "_key", "left")
    return parsed.join(rooted, "_key").select(
        F.col("_key").alias("message"),
        F.col("_parent").alias("parent"),
        F.col("_root").alias("root"),
        F.col("_depth").alias("depth"),
        F.col("_quote_level").alias("quote_level"),
        F.col("_at").alias("position"),
        F.col("_own").alias("text"),
    )


def ordered(threads: DataFrame) -> DataFrame:
    """``threads`` in conversation order, a long conversation spread over as many tasks as it needs."""
    return threads.orderBy("root", "depth", "position", "message")


def as_mail(conversations: DataFrame) -> DataFrame:
    """Turns as mails: each turn's text followed by the two turns before it, quoted by level.

    Turns are looked up by number, so a long conversation is not one group. A turn without a role is quoted
    as someone's; one without a text is not quoted.
    """
    turns = conversations.select("conv_id", "turn", "role", "text")
    mails = turns
    for back in (1, 2):
        before = turns.groupBy("conv_id", (F.col("turn") + back).alias("turn")).agg(
            F.min(F.struct("role", "text")).alias(f"_before_{back}")
        )
        mails = mails.join(before, ["conv_id", "turn"], "left")

    def quoted(text, marks: str):
        return F.concat(F.lit(marks), F.regexp_replace(text, "\n", "\n" + marks))

    def who(role):
        return F.coalesce(role, F.lit("someone"))

    first, second = F.col("_before_1"), F.col("_before_2")
    introduction = F.concat(F.lit("\n\nOn turn "), F.col("turn") - 1, F.lit(", "), who(first["role"]), F.lit(" wrote:\n"))
    deeper = F.concat(F.lit("\n> On turn "), F.col("turn") - 2, F.lit(", "), who(second["role"]), F.lit(" wrote:\n"))
    body = F.concat(
        F.coalesce("text", F.lit("")),
        F.coalesce(F.concat(introduction, quoted(first["text"], "> ")), F.lit("")),
        F.coalesce(F.when(first["text"].isNotNull(), F.concat(deeper, quoted(second["text"], ">> "))), F.lit("")),
    )
    return mails.select("conv_id", "turn", "role", body.alias("text"))

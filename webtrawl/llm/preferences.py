"""Preference pairs: a prompt, and a chosen and a rejected way to go on.

Pairs are conversations with the same first turn, or a conversation and a copy
that goes astray at one assistant turn.  The longest common prefix of turns of a
pair is rendered once, as its prompt; what follows on either side is its chosen
and its rejected completion, in which only assistant turns count for the loss.

Everything is compared turn by turn.  A conversation of any length is spread over
many tasks, and so is a first turn that a third of all conversations share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrawl.llm.common import quoted
from webtrawl.operators.ordered import number_rows, rank_rows
from webtrawl.sources.scratch import materialize

LEARNED_ROLE = "assistant"

# Moves which assistant turns are replaced.
SEED = 7

# Turns of a pair in one row.
EXAMPLE_TURNS = 1_000


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


FOOTER = "\n<|end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, seq): the turns with their places 1, 2, … in the conversation.

    Turns are ordered by number (null first), role and text, so that rows with
    one number, or repeated rows, have a place each.  A null role is empty, a
    null text is empty, and rows with a null conv_id make one conversation.
    """
    plain = conversations.select(
        quoted("conv_id").alias("conv"),
        quoted("turn").alias("turn"),
        F.coalesce(quoted("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(quoted("text").cast("string"), F.lit("")).alias("text"),
    )
    return materialize(
        rank_rows(plain, ["conv"], ["turn", "role", "text"], "seq", large=True), "turns"
    )


def pair_up(turns: DataFrame) -> DataFrame:
    """(conv, chosen_id, rejected_id): conversations with one first turn, by conv_id two by two.

    The smaller conv_id of a pair is the chosen one.  A conversation left over
    has no rejected_id.
    """
    opening = turns.where("seq = 1").select(
        "conv", F.sha2(F.to_json(F.struct("role", "text")), 256).alias("opening")
    )
    ranked = rank_rows(opening, ["opening"], ["conv"], "rank", large=True)
    numbered = ranked.withColumn("pair", F.floor((F.col("rank") + 1) / 2))
    # Struct around the id: a null conv_id is a value like any other.
    pairs = numbered.groupBy("opening", "pair").agg(
        F.min(F.struct("rank", "conv"))["conv"].alias("chosen_id"),
        F.max(F.struct("rank", "conv"))["conv"].alias("last_id"),
        F.count(F.lit(1)).alias("n"),
    )
    both = pairs.select(
        "chosen_id",
        F.when(F.col("n") == 2, F.col("last_id")).alias("rejected_id"),
        (F.col("n") == 2).alias("paired"),
    )
    return materialize(both, "pairs")


def _side(turns: DataFrame, conv: str, name: str) -> DataFrame:
    """(c, seq, name): turns under their pair's key, a struct, as a null id is a value, too."""
    return turns.select(F.struct(F.col(conv).alias("conv")).alias("c"), "seq", F.struct("role", "text").alias(name))


def replaced(turns: DataFrame, seed: int = SEED) -> DataFrame:
    """(conv, seq, role, text, donor): a rejected side for each conversation with an assistant turn.

    One of its assistant turns, picked by conv_id and ``seed``, is replaced by the
    one picked of the next conversation, by conv_id and after the last the first,
    and what followed it is dropped.  No prefix is kept from here: whoever pairs
    the sides has to compare them.
    """
    learned = turns.where(F.col("role") == LEARNED_ROLE).select("conv", "seq", "text")
    ranked = materialize(rank_rows(learned, ["conv"], ["seq"], "place", large=True), "learned")
    counts = materialize(ranked.groupBy(F.col("conv").alias("of")).agg(F.count(F.lit(1)).alias("n")), "counts")
    pick = F.pmod(F.coalesce(F.col("conv"), F.lit(0)) * 31 + seed, F.col("n")) + 1
    picked = ranked.join(counts, F.col("conv").eqNullSafe(F.col("of"))).where(F.col("place") == pick)
    numbered = materialize(number_rows(picked.select("conv", "seq", "text"), ["conv"], "number"), "picked")
    last = numbered.count()
    donors = numbered.select(
        F.when(F.col("number") == 1, last).otherwise(F.col("number") - 1).alias("number"),
        F.col("conv").alias("donor"), F.col("text").alias("other"),
    )
    changes = materialize(
        numbered.join(donors, "number").select(F.col("conv").alias("of"), F.col("seq").alias("at"), "donor", "other"),
        "changes",
    )
    text = F.when(F.col("seq") == F.col("at"), F.col("other")).otherwise(F.col("text")).alias("text")
    return (
        turns.join(changes, F.col("conv").eqNullSafe(F.col("of")))
        .where(F.col("seq") <= F.col("at"))
        .select("conv", "seq", "role", text, "donor")
    )


def _parts(chosen: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, seq, own) of pairs, from (keys, seq, chosen) and (keys, seq, rejected).

    Turns are structs with role and text, and both sides number theirs 1, 2, ….
    The longest common prefix is found by comparing the sides turn by turn; its
    turns are ``prompt`` and come once, as the chosen side has them.  Where one
    side is the beginning of the other it has no turn after the prompt, and where
    they are equal neither has.
    """
    both = materialize(chosen.join(rejected, [*keys, "seq"], "full"), "aligned")
    same = (F.col("chosen.role") == F.col("rejected.role")) & (F.col("chosen.text") == F.col("rejected.text"))
    # Written out, so that the join may split one pair's turns over tasks.
    split = materialize(
        both.where(~F.coalesce(same, F.lit(False))).groupBy(*keys).agg(F.min("seq").alias("split")), "split"
    )
    placed = both.join(split, keys, "left").withColumn(
        "common", F.coalesce(F.col("seq") < F.col("split"), F.lit(True))
    )
    names = F.expr(
        "CASE WHEN common THEN array(struct('prompt' AS part, chosen AS own)) ELSE "
        "filter(array(struct('chosen' AS part, chosen AS own), struct('rejected' AS part, rejected AS own)), "
        "x -> x.own IS NOT NULL) END"
    )
    return placed.select(*keys, "seq", F.explode(names).alias("x")).select(*keys, "x.part", "seq", "x.own")


def _rendered(turns: DataFrame) -> DataFrame:
    """(part, seq, role, text, …) with ``rendered`` for the text, and what of it counts for the loss."""
    learned = F.col("part").isin("chosen", "rejected") & (F.col("role") == LEARNED_ROLE)
    start = F.char_length(header(F.col("role")))
    return turns.select(
        *[c for c in turns.columns if c != "text"],
        F.concat(header(F.col("role")), F.col("text"), F.lit(FOOTER)).alias("rendered"),
        F.when(learned, start).cast("bigint").alias("loss_from"),
        # The end of the turn is learned too.
        F.when(learned, start + F.char_length("text") + len(FOOTER)).cast("bigint").alias("loss_to"),
    )


def segments(conversations: DataFrame) -> DataFrame:
    """One row for each rendered turn of each pair of conversations that begin alike.

    (chosen_id, rejected_id, part, seq, conv_id, role, rendered, loss_from, loss_to).
    ``part`` is prompt, chosen or rejected, or unpaired for the turns of a
    conversation without partner.  A prompt's turns are those of both sides and
    come once.  In ``rendered`` the characters from ``loss_from`` to before
    ``loss_to`` count for the loss; both are null in prompts and for other roles.
    """
    turns = turns_of(conversations)
    pairs = pair_up(turns)
    side = {
        name: turns.select(
            F.struct(F.col("conv")).alias("of"), "seq", F.struct("role", "text", "conv").alias(name)
        )
        for name in ("chosen", "rejected")
    }
    full = pairs.where("paired").select(
        "chosen_id", "rejected_id", F.struct(F.col("chosen_id").alias("conv")).alias("c"),
        F.struct(F.col("rejected_id").alias("conv")).alias("r"),
    )
    left = full.join(side["chosen"], F.col("c") == F.col("of")).select("c", "r", "seq", "chosen")
    right = full.join(side["rejected"], F.col("r") == F.col("of")).select("c", "r", "seq", "rejected")
    paired = _parts(left, right, ["c", "r"]).select(
        F.col("c.conv").alias("chosen_id"),
        F.col("r.conv").alias("rejected_id"),
        "part",
        "seq",
        F.col("own.conv").alias("conv_id"),
        F.col("own.role").alias("role"),
        F.col("own.text").alias("text"),
    )
    lone = pairs.where("not paired").select(F.struct(F.col("chosen_id").alias("conv")).alias("c"))
    alone = lone.join(side["chosen"], F.col("c") == F.col("of")).select(
        F.col("c.conv").alias("chosen_id"),
        F.lit(None).cast(paired.schema["rejected_id"].dataType).alias("rejected_id"),
        F.lit("unpaired").alias("part"),
        "seq",
        F.col("chosen.conv").alias("conv_id"),
        F.col("chosen.role").alias("role"),
        F.col("chosen.text").alias("text"),
    )
    return _rendered(paired.unionByName(alone))


def examples(
    rendered: DataFrame, keys: Sequence[str] = ("chosen_id", "rejected_id"), turns: int = EXAMPLE_TURNS
) -> DataFrame:
    """(keys, piece, prompt, chosen, rejected): each pair in one row, long ones in pieces.

    A piece holds the turns of ``turns`` numbers, the first ones being piece 0, so
    that no row holds more, however long a conversation is; the pieces' texts in
    order are the whole ones.  ``chosen`` and ``rejected`` are structs of text and
    spans (from, to) that count for the loss, in characters of the piece's text.  A
    side without a turn there has an empty text and no span.
    """
    turn = F.struct("seq", "rendered", "loss_from", "loss_to")

    def part(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == name, turn))).alias(name)

    piece = F.floor((F.col("seq") - 1) / turns).alias("piece")
    paired = rendered.where("part != 'unpaired'")
    grouped = paired.groupBy(*keys, piece).agg(part("prompt"), part("chosen"), part("rejected"))

    def text(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: x["rendered"]), "")

    def spans(name: str) -> Column:
        placed = F.aggregate(
            name,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<from:bigint,to:bigint>>)").alias("spans")),
            lambda done, x: F.struct(
                (done["at"] + F.char_length(x["rendered"])).alias("at"),
                F.when(x["loss_from"].isNull(), done["spans"])
                .otherwise(
                    F.concat(
                        done["spans"],
                        F.array(
                            F.struct(
                                (done["at"] + x["loss_from"]).alias("from"),
                                (done["at"] + x["loss_to"]).alias("to"),
                            )
                        ),
                    )
                )
                .alias("spans"),
            ),
        )
        return placed["spans"]

    return grouped.select(
        *keys,
        "piece",
        text("prompt").alias("prompt"),
        *[F.struct(text(n).alias("text"), spans(n).alias("spans")).alias(n) for n in ("chosen", "rejected")],
    )


def spans_text(column: str) -> Column:
    """Spans as text: ``from-to`` joined by commas."""
    return F.array_join(
        F.transform(column, lambda x: F.concat(x["from"].cast("string"), F.lit("-"), x["to"].cast("string"))), ","
    )


def preferences(conversations: DataFrame, seed: int = SEED, turns: int = EXAMPLE_TURNS) -> DataFrame:
    """(conv_id, donor_id, piece, prompt, chosen, chosen_loss, rejected, rejected_loss).

    One row for each conversation with an assistant turn, in pieces of ``turns``
    turns.  The conversation is the chosen side, :func:`replaced` makes the other.
    Where the turn put in equals the one it replaces, or nothing else follows, a
    completion is the empty text with no span.  Rows with a null conv_id make one
    conversation; one without assistant turn makes no pair, as nothing of it could
    be learned.
    """
    whole = turns_of(conversations)
    other = materialize(replaced(whole, seed), "replaced")
    donors = materialize(other.groupBy("conv").agg(F.first(F.struct("donor")).alias("d")), "donors")
    key = F.struct(F.col("conv")).alias("c")
    paired = _side(whole, "conv", "chosen").join(donors.select(key), "c", "left_semi")
    parts = _parts(paired, _side(other, "conv", "rejected"), ["c"])
    found = examples(_rendered(parts.select("c", "part", "seq", "own.role", "own.text")), ["c"], turns)
    return found.join(donors.select(key, "d"), "c").select(
        F.col("c.conv").alias("conv_id"),
        F.col("d.donor").alias("donor_id"),
        "piece",
        "prompt",
        F.col("chosen.text").alias("chosen"),
        spans_text("chosen.spans").alias("chosen_loss"),
        F.col("rejected.text").alias("rejected"),
        spans_text("rejected.spans").alias("rejected_loss"),
    )

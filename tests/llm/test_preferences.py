"""Preference pairs against a plain computation."""

from collections import defaultdict

from pyspark.sql import functions as F

from webtrawl.llm import preferences

TURNS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "hello"),
    (1, 2, "user", "more"),
    (1, 3, "assistant", "left"),
    (2, 0, "user", "hi"),
    (2, 1, "assistant", "hello"),
    (2, 2, "user", "more"),
    (2, 3, "assistant", "right"),
    (2, 4, "user", "thanks"),
    (3, 0, "user", "hi"),
    (4, 0, "system", None),
    (4, 0, "system", None),
    (4, 1, None, "x"),
    (5, 0, "system", ""),
    (5, None, "user", "first"),
    (6, 5, "user", "same"),
    (6, 7, "assistant", "same"),
    (7, 0, "user", "same"),
    (7, 1, "assistant", "same"),
    (None, 0, "user", "hi"),
    (None, 1, "assistant", "no id"),
] + [(k, t, "user", f"turn {t}" if t < 500 else f"turn {t} of {k}") for k in (8, 9) for t in range(600)]


def conversations(spark):
    frame = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")
    return frame.withColumns({c: F.lit("own") for c in ("seq", "rank", "conv", "part", "opening", "c", "r")})


def plain():
    turns = defaultdict(list)
    for conv, turn, role, text in TURNS:
        turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}
    openings = defaultdict(list)
    for c in sorted(turns, key=lambda c: (c is not None, c or 0)):
        openings[turns[c][0]].append(c)
    found = []

    def rendered(left, right, part, seq, conv):
        role, text = turns[conv][seq]
        learned = part in ("chosen", "rejected") and role == "assistant"
        head = f"<|{role}|>\n"
        whole = f"{head}{text}\n<|end|>\n"
        found.append((left, right, part, seq + 1, conv, role, whole, len(head) if learned else None, len(whole) if learned else None))

    for convs in openings.values():
        for k in range(0, len(convs), 2):
            if k + 1 == len(convs):
                for seq in range(len(turns[convs[k]])):
                    rendered(convs[k], None, "unpaired", seq, convs[k])
                continue
            left, right = convs[k], convs[k + 1]
            same = 0
            while same < min(len(turns[left]), len(turns[right])) and turns[left][same] == turns[right][same]:
                same += 1
            for seq in range(len(turns[left])):
                rendered(left, right, "prompt" if seq < same else "chosen", seq, left)
            for seq in range(same, len(turns[right])):
                rendered(left, right, "rejected", seq, right)
    return sorted(found, key=repr)


def test_segments(spark):
    got = sorted((tuple(r) for r in preferences.segments(conversations(spark)).collect()), key=repr)
    assert got == plain()


def test_examples(spark):
    rows = preferences.examples(preferences.segments(conversations(spark))).collect()
    by_pair = {(r.chosen_id, r.rejected_id): r for r in rows}
    example = by_pair[(1, 2)] if (1, 2) in by_pair else by_pair[(2, 3)]
    whole = example.prompt + example.chosen.text
    assert whole.startswith("<|user|>\nhi\n<|end|>\n")
    for side in (example.chosen, example.rejected):
        for span in side.spans:
            assert side.text[span["from"] : span["to"]].endswith("\n<|end|>\n")
            assert side.text[: span["from"]].endswith("<|assistant|>\n")
    long = by_pair[(8, 9)]
    assert long.prompt.count("<|user|>") == 500 and long.chosen.spans == []


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert preferences.segments(none).collect() == []
    assert preferences.preferences(none).collect() == []


def astray(turns):
    """The pairs of ``preferences``, made one by one: {conv: (donor, chosen, rejected)}."""
    learned = {c: [k for k, (role, _) in enumerate(ts) if role == "assistant"] for c, ts in turns.items()}
    convs = sorted((c for c in turns if learned[c]), key=lambda c: (c is not None, c or 0))
    at = {c: learned[c][((c or 0) * 31 + 7) % len(learned[c])] for c in convs}
    found = {}
    for k, c in enumerate(convs):
        donor = convs[(k + 1) % len(convs)]
        found[c] = donor, turns[c], [*turns[c][: at[c]], ("assistant", turns[donor][at[donor]][1])]
    return found


def written(turns):
    text, spans = "", []
    for role, words in turns:
        start = len(text)
        text += f"<|{role}|>\n{words}\n<|end|>\n"
        if role == "assistant":
            spans.append(f"{start + len(role) + 5}-{len(text)}")
    return text, ",".join(spans)


def test_preferences(spark):
    """Every conversation with an assistant turn, compared with a plain computation."""
    turns = defaultdict(list)
    rows = TURNS + [(10, t, "assistant", "same") for t in range(3)] + [(11, 0, "assistant", "same")]
    rows += [(11, 1, "user", "goes on"), (12, 0, "assistant", "same")]
    # Two conversations of one long opening, and a hot one whose turns fill many pieces.
    rows += [(k, t, ["user", "assistant"][t % 2], f"t{t}") for k in (20, 21) for t in range(70)]
    for conv, turn, role, text in rows:
        turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}
    wanted, kinds = [], set()
    for conv, (donor, chosen, rejected) in astray(turns).items():
        same = 0
        while same < min(len(chosen), len(rejected)) and chosen[same] == rejected[same]:
            same += 1
        kinds.add((same == len(chosen), same == len(rejected)))
        for piece in range(-(-len(chosen) // 30)):
            lo, hi = 30 * piece, 30 * (piece + 1)
            prompt, left = chosen[lo : min(hi, same)], chosen[max(lo, same) : hi]
            right = rejected[max(lo, same) : hi]
            wanted.append((conv, donor, piece, written(prompt)[0], *written(left), *written(right)))
    # Pairs that differ, those where one side is the beginning of the other, and equal ones.
    assert kinds == {(False, False), (False, True), (True, True)}
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    frame = frame.withColumns({c: F.lit("own") for c in ("seq", "rank", "conv", "part", "donor", "c", "of", "at")})
    got = sorted((tuple(r) for r in preferences.preferences(frame, turns=30).collect()), key=repr)
    assert got == sorted(wanted, key=repr)

"""Conversations as budgeted training windows.

A window holds the conversation's system turn, some of the turns before as
repeated history, and new turns up to a token budget. Only whole turns are
taken, and only the new assistant turns are targets, so every one of them is
learned from once.

Prefix sums of the turns' tokens choose the windows. They are formed in two
levels, blocks of turns and then totals of blocks, and they cut a conversation
into stretches of a bounded number of tokens. A stretch is one small group: its
windows are found by binary search in its prefix sums. So the turns of one huge
conversation spread over as many tasks as it has stretches.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from admitflow.llm.bpe import read_spec
from admitflow.llm.common import by_batch, held
from admitflow.llm.packing import library_encoder
from admitflow.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)
ESCAPED = re.compile(r"\\([\\|n])")
# Turns in one block of the first level of prefix sums, by turn number.
BLOCK = 256
# Windows in one stretch, about.
STRETCH = 16


def escape(text: str) -> str:
    r"""Make control strings ordinary: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``. No escaped text holds ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    """As a text, and on one line."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(window: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(window)]


def counted_turns(conversations: DataFrame, path: str) -> DataFrame:
    """(conv_id, turn, role, text, tokens): null roles and texts are empty; tokens are those of the rendered turn."""
    spec = conversations.sparkSession.sparkContext.broadcast(read_spec(path))
    source = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )

    def make():
        encode = held(library_encoder, spec.value)
        return lambda c: c | {"tokens": [len(encode(render(r, t))) for r, t in zip(c["role"], c["text"])]}

    key = conversations.schema["conv_id"].dataType.simpleString()
    return by_batch(source, f"conv_id {key}, turn long, role string, text string, tokens long", make)


def with_prefix(turns: DataFrame) -> DataFrame:
    """Add ``before``: the tokens of the conversation's earlier turns. Turns are ordered by number, role and text, null numbers first."""
    blocked = turns.withColumn("_block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("conv_id", "_block").agg(F.sum("tokens").alias("_total"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_of"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    numbered = blocked.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_of"))
    return numbered.join(offsets, same).withColumn("before", F.col("_inside") + F.col("_offset")).select(*turns.columns, "before")


def span_ends(sums: list[int], budget: int) -> list[int]:
    """Ends of consecutive spans: each takes as many turns as the budget holds, and one turn at least.

    ``sums`` are prefix sums, beginning with 0.
    """
    ends, at = [], 0
    while at < len(sums) - 1:
        at = max(at + 1, bisect_right(sums, sums[at] + budget, at + 1) - 1)
        ends.append(at)
    return ends


def _windows(stretch: int, turns: list[dict], system: dict | None, budget: int, history: int) -> list[dict]:
    """The windows of one stretch. ``turns``: in order, first those of the stretch before that may be repeated."""
    own = [t for t in turns if t["stretch"] == stretch]
    past = [t for t in turns if t["stretch"] != stretch]
    begins = bool(system) and stretch == 0
    room = budget - history - (system["tokens"] if system else 0)
    sums = [0]
    for t in own:
        sums.append(sums[-1] + t["tokens"])
    out, at = [], 0
    for number, end in enumerate(span_ends(sums, max(room, 1))):
        head = [system] if system and not (begins and at == 0) else []
        repeated: list[dict] = []
        left = min(history, budget - sum(t["tokens"] for t in head) - (sums[end] - sums[at]))
        for t in reversed(past + own[:at]):
            if t["tokens"] > left or (system and t["first"]):
                break
            left -= t["tokens"]
            repeated.insert(0, t)
        text, spans = "", []
        for t in head + repeated:
            text += render(t["role"], t["text"])
        for t in own[at:end]:
            text += f"{START}{escape_role(t['role'])}\n"
            body = escape(t["text"])
            if t["role"] == "assistant":
                spans.append({"start": len(text), "end": len(text) + len(body)})
            text += f"{body}{END}\n"
        out.append({"number": number, "formatted": text, "loss": spans, "repeated": len(head) + len(repeated), "turns": len(head) + len(repeated) + end - at})
        at = end
    return out


def windows(conversations: DataFrame, path: str, budget: int = 1024, history: int = 128) -> DataFrame:
    """(conv_id, stretch, number, formatted, loss, repeated, turns): windows in order of stretch and number.

    ``loss`` are spans of ``formatted`` in code points, one for each assistant
    text that is new there; ``repeated`` turns at the front are known from
    earlier windows: the system turn and at most ``history`` tokens of turns. A
    window has at most ``budget`` tokens, unless the system turn and its one new
    turn need more; it then repeats no others. Every row is one turn, repeated rows too. The system turn is the first
    one, if its role is "system". A null conversation is a conversation.
    """
    # Stored, since the prefix sums read it twice and counting tokens is the work.
    turns = cut_lineage(counted_turns(conversations, path), "counted-turns")
    ordered = with_prefix(turns)
    first = ordered.where("before = 0").groupBy("conv_id").agg(F.min_by(F.struct("role", "text", "tokens"), F.struct("turn", "role", "text")).alias("head"))
    system = first.where("head.role = 'system'").select(F.col("conv_id").alias("_conv"), F.col("head").alias("system"))

    size = STRETCH * budget
    placed = ordered.withColumn("stretch", F.floor(F.col("before") / size))
    after = F.col("before") + F.col("tokens")
    border = (F.col("stretch") + 1) * size
    into = F.greatest(F.floor(after / size), F.col("stretch") + 1)
    goals = F.when(after > border - history, F.array("stretch", into)).otherwise(F.array("stretch"))
    turn = F.struct("before", "turn", "role", "text", "tokens", "stretch", (F.col("before") == 0).alias("first"))
    groups = placed.select("conv_id", F.explode(goals).alias("goal"), turn.alias("t")).groupBy("conv_id", "goal").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    groups = groups.join(system, groups.conv_id.eqNullSafe(F.col("_conv")), "left").drop("_conv")

    def make():
        def step(c):
            out = {name: [] for name in ("conv_id", "stretch", "number", "formatted", "loss", "repeated", "turns")}
            for conv, goal, ts, head in zip(c["conv_id"], c["goal"], c["ts"], c["system"]):
                for w in _windows(goal, ts, head, budget, history):
                    for name, value in {"conv_id": conv, "stretch": goal, **w}.items():
                        out[name].append(value)
            return out

        return step

    key = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, stretch long, number long, formatted string, loss array<struct<start:long,end:long>>, repeated int, turns int"
    return by_batch(groups, schema, make)


def read_back(found: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: digests of its turns and of the text under the loss mask.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    The windows of a conversation pass one task in order, as its digests are of
    the whole; the task holds one window at a time.
    """
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    class Digest:
        def __init__(self):
            self.conv, self.open = None, False

        def begin(self, conv):
            self.conv, self.open = conv, True
            self.turns, self.loss, self.counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]

        def close(self, out):
            if self.open:
                row = (self.conv, self.counts[0], self.turns.hexdigest(), self.counts[1], self.loss.hexdigest(), self.counts[2])
                for name, value in zip(names, row):
                    out[name].append(value)

        def __call__(self, c):
            out = {name: [] for name in names}
            for conv, text, loss, repeated in zip(c["conv_id"], c["formatted"], c["loss"], c["repeated"]):
                if not self.open or conv != self.conv:
                    self.close(out)
                    self.begin(conv)
                for role, body in parse(text)[repeated:]:
                    self.turns.update(f"{role}\n{body}\n".encode())
                    self.counts[0] += 1
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    self.loss.update(body.encode())
                    self.counts[1] += len(body)
                self.counts[2] += len(text)
            return out

        def finish(self):
            out = {name: [] for name in names}
            self.close(out)
            return out

    dealt = found.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "number")
    key = found.schema["conv_id"].dataType.simpleString()
    return by_batch(
        dealt.select("conv_id", "formatted", "loss", "repeated"),
        f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        Digest,
    )

"""Conversation structure repair: the cheapest edits that make the roles of a conversation read system (once, if at all), user, assistant,
user, assistant and so on, found by dynamic programming that conversations share through a trie.

Each row becomes one symbol: what its role begins with and whether it is cut off, or that it has to go (blank, or seen before). The
symbols of a conversation are its signature. Distinct signatures are range-partitioned and sorted, so that those with a common beginning
stand side by side; going through them in order is a walk over their prefix trie. A layer (for each state of the roles the
least cost, the place of its edits in ASCII order among the layer's, and the step that led there) is computed when a node is entered and
kept until it is left, so once for each shared prefix; a signature's answer is read off at its terminal node.

All strings of edits of a layer have equally many letters that take up a row, and end with one, so none begins another: equal costs
are decided by the order of the strings before and then by the letters added, and the strings themselves are only spelt at the end.
More than one insertion before a row, and more than two at the end, are never cheapest.

A conversation is read as a sorted stream: first for its signature (without texts), then with the edits as its first row, which are
applied to the texts one by one. So a conversation of any length is never held whole; what is held of it is its signature and its
edits, a letter or two for a row, which are one value of the result. Rows seen before are found by counts of (conversation, role,
digest of the text), added up before the shuffle.

Defined cases: nulls of any column count as one space, in the damage too; a null turn comes first and is left out of gaps; rows of one
turn are in order of role and of the SHA-256 of the text; rows repeated in the table are repeated rows of the conversation; a null
conv_id is a conversation; a role of any other kind has to be given a new one or go; a conversation without rows has no faults, no
edits, and the hash of an empty text; an empty table gives an empty result; only conv_id, turn, role and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.common import SPACES, table, written

#: States of the roles so far: nothing, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: What an inserted row, or a row with a new role, is after each state.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What can be done at a row, in ASCII order.
STEPS = ("D", "IK", "IR", "K", "R")
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: What the end needs in each state: it must follow an assistant or nothing at all.
ENDING = ("", "II", "I", "")
#: A row that has to go; otherwise a symbol is s, u, a or o (another role), and upper case where the text is cut off.
GONE = "x"
NEVER = 1 << 60


def _kept(state: int, who: str) -> int | None:
    if who == "s":
        return SYSTEM if state == NOTHING else None
    if who == "u":
        return USER if state != USER else None
    return ASSISTANT if who == "a" and state == USER else None


def _moves(symbol: str) -> list[tuple[int, int, int, int]]:
    """(state before, step, cost, state after) of all that can be done at a row."""
    out = [(q, 0, DELETE, q) for q in range(STATES)]
    if symbol == GONE:
        return out
    fault = CUT_OFF if symbol.isupper() else 0
    for q in range(STATES):
        for inserted, p in ((0, q), (1, AFTER[q])):
            then = _kept(p, symbol.lower())
            if then is not None:
                out.append((q, STEPS.index("IK" if inserted else "K"), INSERT * inserted + KEEP + fault, then))
            out.append((q, STEPS.index("IR" if inserted else "R"), INSERT * inserted + REROLE + fault, AFTER[p]))
    return out


MOVES = {symbol: _moves(symbol) for symbol in "suaoSUAO" + GONE}


class Walk:
    """The layers from the root of the trie to the node where the walk stands."""

    def __init__(self) -> None:
        self.at = ""
        self.costs = array("q", [0] + [NEVER] * (STATES - 1))
        self.order = bytearray(STATES)
        self.back = bytearray(STATES)
        #: Layers computed so far.
        self.computed = 0

    def go(self, signature: str) -> None:
        shared, most = 0, min(len(self.at), len(signature))
        if self.at[:most] == signature[:most]:
            shared = most
        else:
            low, high = 0, most
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self.at[:mid] == signature[:mid] else (low, mid - 1)
            shared = low
        for layers in (self.costs, self.order, self.back):
            del layers[STATES * (shared + 1) :]
        for symbol in signature[shared:]:
            self._enter(symbol)
        self.at = signature

    def _enter(self, symbol: str) -> None:
        costs, order = self.costs[-STATES:], self.order[-STATES:]
        best: list[tuple[int, int, int, int]] = [(NEVER, 0, 0, 0)] * STATES
        for q, step, cost, then in MOVES[symbol]:
            if costs[q] < NEVER and (found := (costs[q] + cost, order[q], step, q)) < best[then]:
                best[then] = found
        places = sorted((b[1], b[2], q) for q, b in enumerate(best) if b[0] < NEVER)
        order = bytearray(STATES)
        for place, (_, _, q) in enumerate(places):
            order[q] = place
        self.costs.extend(b[0] for b in best)
        self.order.extend(order)
        self.back.extend(b[2] << 2 | b[3] for b in best)
        self.computed += 1

    def answer(self) -> tuple[int, str]:
        """Least cost and edits of the signature where the walk stands."""
        costs, order = self.costs[-STATES:], self.order[-STATES:]
        cost, _, state = min((costs[q] + INSERT * len(ENDING[q]), order[q], q) for q in range(STATES))
        letters = [ENDING[state]]
        for i in range(len(self.at), 0, -1):
            step = self.back[STATES * i + state]
            letters.append(STEPS[step >> 2])
            state = step & 3
        return cost, "".join(reversed(letters))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = Walk()
    for b in batches:
        out = []
        for signature in b.column("signature").to_pylist():
            walk.go(signature)
            out.append((signature, *walk.answer()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["signature", "cost", "audit"])


def answers(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct signature."""
    sorted_ = signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    return sorted_.mapInArrow(_answers, "signature string, cost long, audit string")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, dropped: rows after the damage; a row that the damage drops stays, marked, so that its
    conversation is known."""
    rows = conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), F.pmod(F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")), F.lit(20)).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(0), F.when(F.col("_k") == 3, 1).otherwise(0))
    return rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("_k") == 0).alias("dropped"))


def untouched(conversations: DataFrame) -> DataFrame:
    """As `damaged`, without damage: what the repair of real conversations begins with."""
    return conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _places() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts, with who they are of (s, u, a, o), blank, cut (off) and again (the same role and text at an
    earlier turn), written."""
    ends = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    narrow = written(rows.select("conv_id", "turn", "role", "copy", "dropped", _digest(), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("who"),
                                 (F.length(ends) == 0).alias("blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("cut")), "rows")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    same = narrow.where(~F.col("dropped")).groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(turn).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = narrow.join(same, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    return joined.withColumn("again", F.coalesce(turn > F.col("_first"), F.lit(False))).drop("_c", "_r", "_d", "_first")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of a conversation while its rows pass in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.signature = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = self.last = None
        self.who = ""

    def take(self, row: dict) -> None:
        if row["dropped"]:
            return
        if row["turn"] is not None and row["turn"] != self.turn:
            self.least = row["turn"] if self.turns == 0 else self.least
            self.turns, self.turn = self.turns + 1, row["turn"]
        same = (row["turn"], row["role"], row["digest"])
        if row["blank"]:
            self.blank, symbol = self.blank + 1, GONE
        elif row["again"] or same == self.last:
            self.duplicate, symbol = self.duplicate + 1, GONE
        elif row["cut"]:
            self.truncated, symbol = self.truncated + 1, row["who"].upper()
        else:
            symbol = row["who"]
        self.illegal += bool(self.who) and self.who + row["who"] not in LEGAL
        self.last, self.who = same, row["who"]
        self.signature += symbol.encode()

    def row(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, self.signature.decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "signature", *COUNTS]
    whole = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "signature" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names)
    now = None
    for b in batches:
        out = []
        for row in b.to_pylist():
            if now is None or row["conv_id"] != now.conv_id:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(row["conv_id"])
            now.take(row)
        if out:
            yield whole(out)
    if now is not None:
        yield whole([now.row()])


def diagnosed(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal of every conversation, written."""
    streams = marked(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_places())
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return written(streams.mapInArrow(_signatures, f"conv_id long, signature string, {kinds}"), "signatures")


def _edited(audit: str, rows: Iterator[dict]) -> Iterator[tuple[str, int | None, str, str]]:
    """edit, turn, role and text of the rows that the edits leave or make."""
    state = NOTHING
    for edit in audit:
        row = next(rows) if edit != "I" else {"turn": None, "text": ""}
        if edit == "D":
            continue
        if edit == "K":
            state = _kept(state, row["role"][:1])
            yield edit, row["turn"], row["role"], row["text"]
        else:
            state = AFTER[state]
            yield edit, row["turn"], ROLE[state], row["text"]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[dict]]]:
    """The head of each conversation and its rows; both must be taken in order."""
    rows = (r for b in batches for small in (b.slice(at, 256) for at in range(0, b.num_rows, 256)) for r in small.to_pylist())
    waiting = [next(rows, None)]

    def following() -> Iterator[dict]:
        while (row := next(rows, None)) is not None:
            if row["head"] is not None:
                waiting[0] = row
                return
            yield row

    while (head := waiting[0]) is not None:
        waiting[0] = None
        own = following()
        yield head["head"] | {"conv_id": head["conv_id"]}, own
        for _ in own:
            pass


def _with_heads(rows: DataFrame) -> DataFrame:
    """Rows of each conversation after a row with its counts, cost and audit, in order."""
    found = diagnosed(rows)
    heads = found.join(written(answers(found), "answers"), "signature").select("conv_id", F.struct(*COUNTS, "cost", "audit").alias("head"))
    texts = rows.where(~F.col("dropped")).select("conv_id", "turn", "role", "text", "copy", _digest())
    return texts.unionByName(heads, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), *_places())


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), turn, role, text of every conversation after its repair."""
    schema = "conv_id long, place long, edit string, turn long, role string, text string"
    kinds = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for head, own in _streams(batches):
            for place, made in enumerate(_edited(head["audit"], own)):
                out.append((head["conv_id"], place, *made))
                size += len(made[-1]) + 64
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return _with_heads(rows).mapInArrow(apply, schema)


def report(rows: DataFrame) -> DataFrame:
    """Faults, cost, edits and the digest of the repaired text of every conversation."""
    kinds = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, own in _streams(batches):
            text, first = hashlib.sha256(), True
            for _, _, role, said in _edited(head["audit"], own):
                text.update(f"{'' if first else chr(10)}{role}:{said}".encode())
                first = False
            out.append((head["conv_id"], *(head[c] for c in (*COUNTS, "cost", "audit")), text.hexdigest()))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    longs = ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
    return _with_heads(rows).mapInArrow(apply, f"conv_id long, {longs}, audit string, repaired_sha256 string")


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    return report(damaged(table(spark, sf_dir, "conversations")))

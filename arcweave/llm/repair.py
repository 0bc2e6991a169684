"""Conversations damaged and repaired by a dynamic program over a grammar (operator 12).

Rows are damaged by crc32 of `conv_id:turn` modulo 20 (0 drops the row, 1 empties its text, 2 removes [.!?] from it, 3 repeats it, 4 sets its role to user) and then
ordered by turn, null first, rows of one turn by role and text. A row becomes a symbol of one character: its role's initial and its first fault. A conversation is the string of its symbols, and
equal strings are repaired once.

Re-Pair symbols stand for frequent pairs of symbols. Rounds of Spark jobs count the neighbours in all distinct strings; each round makes rules of the most frequent pairs, as many
as never overlap (no symbol is the left one of a pair and the right one of another), until no pair is there twice, nothing gets shorter by more than a hundredth, or there are `most_rules`, which
bounds what goes to the tasks; pairs beyond it stay as they are and are worked out in their strings. A symbol's transfer matrix has for each two states of the automaton of
`(s?(ua)+)?` the least cost of repairing what the symbol stands for from the one to the other, and the audit as a rope: a short string, or two ropes one after the other with their length and
hash. A rule's matrix is the min-plus product of those of its two symbols, made once, bottom-up, for all conversations. Audits of equal cost are compared as strings; as two of them
never are one the beginning of the other (they would differ by insertions, which cost), the least audit of a product comes from the least audits of its parts.

Rows lie in ranges of the order of all rows, so that a conversation of any length spreads over many tasks; what meets in one task for a conversation is what the result has in one cell (the audit, one
character a row) and the bytes of its digest, in order and a piece at a time.

Null conv_ids are a conversation; null role, text or turn count as one space (turn: in the hashed text). Conversations without rows after damage have zeros, an empty audit and the empty
string's digest. Repeated rows are duplicates. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, read_table
from .sequences import PIECE_BYTES, in_order, joined_sha256, part_of

#: Costs of edits; an undeleted truncated row adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES, FAULTS = "sua?", ("none", "blank", "duplicate", "truncated")
#: A symbol's character: FIRST plus four times the place of its role in ROLES plus that of its fault in FAULTS.
FIRST = 65
WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
#: States of the automaton of (s?(ua)+)?: nothing yet, after s, after u, after a. STEPS[role] has the moves; the first and the last state accept.
STATES = range(4)
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTING = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
#: Longest rope that is a plain string.
SHORT = 128
HASH, FACTOR = (1 << 61) - 1, 0x1F3A5C7E9B2D4681


class Rope:
    """Two ropes one after the other."""

    __slots__ = ("left", "right", "size", "mark")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.size = size_of(left) + size_of(right)
        self.mark = (mark_of(left) * pow(FACTOR, size_of(right), HASH) + mark_of(right)) % HASH


def size_of(rope) -> int:
    return rope.size if isinstance(rope, Rope) else len(rope)


def mark_of(rope) -> int:
    if isinstance(rope, Rope):
        return rope.mark
    value = 0
    for c in rope.encode():
        value = (value * FACTOR + c) % HASH
    return value


def joined(left, right):
    size = size_of(left) + size_of(right)
    return flat(left) + flat(right) if size <= SHORT else Rope(left, right) if left and right else left or right


def flat(rope) -> str:
    if not isinstance(rope, Rope):
        return rope
    out, stack = [], [rope]
    while stack:
        now = stack.pop()
        if isinstance(now, Rope):
            stack += [now.right, now.left]
        else:
            out.append(now)
    return "".join(out)


def less(a, b) -> bool:
    """a comes before b in the order of strings. Equal beginnings are skipped by their hashes."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if not size_of(x) or not size_of(y):
            left += [x] if size_of(x) else []
            right += [y] if size_of(y) else []
        elif size_of(x) == size_of(y) and (x is y or mark_of(x) == mark_of(y)):
            continue
        elif isinstance(x, Rope) and size_of(x) >= size_of(y):
            left += [x.right, x.left]
            right.append(y)
        elif isinstance(y, Rope):
            left.append(x)
            right += [y.right, y.left]
        elif isinstance(x, Rope):
            left += [x.right, x.left]
            right.append(y)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x < y
            left += [x[n:]]
            right += [y[n:]]
    return not any(map(size_of, left)) and any(map(size_of, right))


Matrix = dict  # {(state, state): (cost, rope)}


def put(out: Matrix, at: tuple[int, int], cost: int, rope) -> None:
    old = out.get(at)
    if old is None or cost < old[0] or cost == old[0] and less(rope, old[1]):
        out[at] = (cost, rope)


def product(a: Matrix, b: Matrix) -> Matrix:
    best: dict[tuple[int, int], list] = {}
    for (i, k), (cost, rope) in a.items():
        for j in STATES:
            if (k, j) in b:
                more, end = b[k, j]
                now = best.get((i, j))
                if now is None or cost + more < now[0]:
                    best[i, j] = [cost + more, (rope, end)]
                elif cost + more == now[0]:
                    now.append((rope, end))
    out: Matrix = {}
    for at, (cost, *pairs) in best.items():  # ropes are made and compared for ties alone
        for pair in pairs:
            put(out, at, cost, joined(*pair))
    return out


def insertions() -> Matrix:
    """Any number of inserted rows."""
    out: Matrix = {(i, i): (0, "") for i in STATES}
    for _ in STATES:
        for (i, k), (cost, rope) in list(out.items()):
            for role in "ua":
                if k in STEPS[role]:
                    put(out, (i, STEPS[role][k]), cost + INSERT, rope + "I")
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """One row and what is inserted behind it."""
    role, fault = ROLES[(ord(symbol) - FIRST) // 4], FAULTS[(ord(symbol) - FIRST) % 4]
    out: Matrix = {(i, i): (DELETE, "D") for i in STATES}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for new in "sua":
            for i, j in STEPS[new].items():
                if new == role:
                    put(out, (i, j), KEEP + more, "K")
                elif new in NAMES:
                    put(out, (i, j), REROLE + more, "R")
    return product(out, insertions())


Rules = dict[tuple[int, int], int]


def compress(text: str, rounds: list[Rules]) -> list[int]:
    """The symbols of a string after all rounds."""
    now = list(map(ord, text))
    for rules in rounds:
        if len(now) < 2:
            break
        out, i, n = [], 0, len(now)
        while i < n:
            new = rules.get((now[i], now[i + 1])) if i + 1 < n else None
            out.append(now[i] if new is None else new)
            i += 1 if new is None else 2
        now = out
    return now


@dataclass
class Grammar:
    """Rounds of rules {(left, right): symbol} in the order in which they apply, and the matrix of each symbol."""

    rounds: list[Rules]
    matrices: dict[int, Matrix]

    @classmethod
    def empty(cls) -> Grammar:
        return cls([], {FIRST + i: symbol_matrix(chr(FIRST + i)) for i in range(len(ROLES) * len(FAULTS))})

    def add(self, counts: list[tuple[int, int, int]], room: int) -> int:
        """A round of rules from (left, right, times), the most frequent first; the number of rows of the strings that they shorten."""
        rules: Rules = {}
        lefts, rights, saved = set(), set(), 0
        for a, b, times in counts:
            if len(rules) >= room:
                break
            if a in rights or b in lefts:
                continue
            lefts.add(a)
            rights.add(b)
            new = max(self.matrices) + 1
            self.matrices[new] = product(self.matrices[a], self.matrices[b])
            rules[a, b] = new
            saved += times
        self.rounds.append(rules)
        return saved

    def repair(self, text: str) -> tuple[int, str]:
        """Least cost and audit of a string."""
        parts = [self.matrices[x] for x in compress(text, self.rounds)]
        while len(parts) > 1:  # neighbours two by two, so that ropes stay shallow
            parts = [product(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        whole = product(insertions(), parts[0]) if parts else insertions()
        out: Matrix = {}
        for j in ACCEPTING:
            if (0, j) in whole:
                put(out, (0, 0), *whole[0, j])
        return out[0, 0][0], flat(out[0, 0][1])


def learn_grammar(strings: DataFrame, most_rules: int = 4096, most_rounds: int = 24) -> Grammar:
    """Rules from the neighbours in all strings (seq)."""
    grammar = Grammar.empty()
    rounds, room = grammar.rounds, most_rules

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("seq").to_pylist():
                now = compress(text, rounds)
                found.update(zip(now[:-1], now[1:], strict=True))
                found[0, 0] += len(now)
            if len(found) > 1_000_000:
                yield rows_of(found)
                found = Counter()
        yield rows_of(found)

    def rows_of(found: Counter) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(found.values()), pa.int64())], ["a", "b", "times"])

    for _ in range(most_rounds):
        pairs = strings.select("seq").mapInArrow(count, "a long, b long, times long").groupBy("a", "b").agg(F.sum("times").alias("times"))
        top = pairs.filter("times > 1 or a = 0").orderBy(F.desc("times"), "a", "b").limit(2 * most_rules + 1).collect()
        length = next((r["times"] for r in top if r["a"] == 0), 0)
        counts = [tuple(r) for r in top if r["a"] != 0]
        if not counts or room <= 0:
            break
        saved = grammar.add(counts, room)
        room -= len(grammar.rounds[-1])
        if saved * 100 < length:
            break
    return grammar


def damaged_rows(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = (F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20).cast("int")
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), what.alias("what")).filter("what <> 0")
    text = F.when(F.col("what") == 1, F.lit("")).when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def symbol_rows(ordered: DataFrame) -> DataFrame:
    """(conv_id, at, symbol): each row's role and first fault."""
    shared = materialize(ordered.groupBy("content").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "equal-rows")
    again = join_counted(ordered.select("content", "at"), shared, "content").filter("at > first_at").select("at")
    rows = ordered.join(again.withColumn("again", F.lit(True)), "at", "left")
    place = F.instr(F.lit(ROLES[:3]), F.substring("role", 1, 1))
    role = F.when((place == 0) | (F.col("role") == ""), F.lit(len(ROLES))).otherwise(place) - 1
    fault = F.when(F.col("last") == "", F.lit(1)).when(F.col("again"), F.lit(2)).when(~F.col("last").isin(".", "!", "?"), F.lit(3)).otherwise(F.lit(0))
    return rows.select("conv_id", "at", F.chr((4 * role + fault + FIRST).cast("long")).alias("symbol"))


SEGMENTS = "conv_id long, at long, seq string"


def segments(symbols: DataFrame) -> DataFrame:
    """(conv_id, at, seq) of neighbouring rows of a conversation that a task has."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, now, next_at = [], None, None
            for conv, at, symbol in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "symbol")), strict=True):
                if at != next_at or conv != now[0]:
                    now = (conv, at, [])
                    out.append(now)
                now[2].append(symbol)
                next_at = at + 1
            columns = zip(*out, strict=True) if out else ((), (), ())
            conv, at, seq = columns
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(at, pa.int64()), pa.array(["".join(x) for x in seq], pa.string())], ["conv_id", "at", "seq"])

    return symbols.mapInArrow(join, SEGMENTS)


def count_faults(text: str) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated and illegal neighbours of a string."""
    places = [ord(x) - FIRST for x in text]
    faults = Counter(x % 4 for x in places)
    roles = [ROLES[x // 4] for x in places]
    return faults[1], faults[2], faults[3], sum(a + b not in LEGAL for a, b in zip(roles[:-1], roles[1:], strict=True))


JUDGED = "seq string, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def judge_strings(strings: DataFrame, grammar: Grammar) -> DataFrame:
    """JUDGED of strings (seq, n)."""
    shared = strings.sparkSession.sparkContext.broadcast(grammar)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*count_faults(x), *shared.value.repair(x)) for x in batch.column("seq").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("n"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], [f.split()[0] for f in JUDGED.split(", ")])

    return strings.mapInArrow(judge, JUDGED)


def audit_parts(audit: str, sizes: list[int]) -> list[tuple[str, int]]:
    """An audit cut after so many rows each, with the number of rows of the repaired conversation that come before; insertions go with the row before them, or the first."""
    out, at, made = [], 0, 0
    for k, size in enumerate(sizes):
        start, before = at, made
        while at < len(audit) and (size > 0 or audit[at] == "I" or k == len(sizes) - 1):
            size -= audit[at] != "I"
            made += audit[at] != "D"
            at += 1
        out.append((audit[start:at], before))
    return out


PARTS = "conv_id long, at long, own boolean, audit string, before long, system boolean, last boolean"


def dealt_audits(judged: DataFrame) -> DataFrame:
    """For each segment of (conv_id, parts, seq, audit) its part of the audit."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts, seq, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "parts", "seq", "audit")), strict=True):
                sizes = [p["size"] for p in parts]
                kept = next((i for i, x in enumerate(x for x in audit if x != "I") if x != "D"), None)
                head = audit.lstrip("D")[:1]
                system = head == "K" and kept is not None and ROLES[(ord(seq[kept]) - FIRST) // 4] == "s"
                for k, (p, (piece, before)) in enumerate(zip(parts, audit_parts(audit, sizes), strict=True)):
                    out.append((conv, p["at"], len(parts) == 1, piece, before, system, k == len(parts) - 1))
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in PARTS.split(", ")])

    return judged.mapInArrow(deal, PARTS)


def repaired_digests(ordered: DataFrame, audits: DataFrame, n_parts: int) -> DataFrame:
    """(conv_id, sha256) of the repaired conversations that have rows. A conversation in one segment is hashed where it lies, the pieces of others come together."""
    rows = ordered.select("at", F.lit(1).alias("kind"), "conv_id", "role", "text", *(F.lit(None).cast(t).alias(c) for c, t in (("own", "boolean"), ("audit", "string"), ("before", "long"), ("system", "boolean"))))
    marks = audits.select("at", F.lit(0).alias("kind"), "conv_id", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "own", "audit", "before", "system")
    dealt = rows.unionByName(marks).repartitionById(n_parts, part_of()).sortWithinPartitions("at", "kind")
    schema = "conv_id long, at long, piece binary, sha256 string"

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, audit, i, made, system, start = None, False, "", 0, 0, False, None
        state, held, size = None, [], 0

        def give(role: str, text: str) -> None:
            nonlocal made, size
            line = ("\n" if made else "") + f"{role}:{text}"
            made += 1
            data = line.encode("utf-8", "surrogatepass")
            if own:
                state.update(data)
            else:
                held.append(data)
                size += len(data)

        def role_now() -> str:
            return "assistant" if (made - system) % 2 else "user"

        def insert() -> None:
            nonlocal i
            while i < len(audit) and audit[i] == "I":
                give(role_now(), "")
                i += 1

        def close() -> Iterator[tuple]:
            nonlocal held, size
            if start is not None:
                if own:
                    yield (conv, start, None, state.hexdigest())
                else:
                    yield (conv, at_piece, b"".join(held), None)
                held, size = [], 0

        at_piece = None
        for batch in batches:
            out = []
            for at, kind, new, role, text, alone, letters, before, has_system in zip(*(batch.column(c).to_pylist() for c in ("at", "kind", "conv_id", "role", "text", "own", "audit", "before", "system")), strict=True):
                if kind == 0:
                    out.extend(close())
                    conv, own, audit, i, made, system, start, at_piece = new, alone, letters, 0, before, has_system, at, at
                    state = hashlib.sha256() if own else None
                    insert()
                    continue
                if size >= PIECE_BYTES:
                    out.append((conv, at_piece, b"".join(held), None))
                    held, size, at_piece = [], 0, at
                letter = audit[i]
                i += 1
                if letter != "D":
                    give(role if letter == "K" else role_now(), text)
                insert()
            yield rows_of(out)
        yield rows_of(list(close()))

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.string()], strict=True)], ["conv_id", "at", "piece", "sha256"])

    found = materialize(dealt.mapInArrow(hash_rows, schema), "repaired")
    spread = joined_sha256(found.filter("piece is not null").select("conv_id", "at", "piece"), ["conv_id"], "repaired-whole")
    return found.filter("sha256 is not null").select("conv_id", "sha256").unionByName(spread)


def repair_conversations(convs: DataFrame, most_rules: int = 4096) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every original conv_id."""
    rows = damaged_rows(convs)
    ordered = in_order(rows, ["conv_id", "turn", "role", "text"])
    content = F.unhex(F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).cast("binary"), F.unhex(F.lit("FF")), F.encode("role", "UTF-8"), F.unhex(F.lit("FF")), F.encode("text", "UTF-8"))))
    ordered = materialize(ordered.withColumns({"content": content, "last": F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))}), "damaged")
    n_parts = (ordered.agg(F.max(part_of())).first()[0] or 0) + 1
    pieces = materialize(segments(symbol_rows(ordered).repartitionById(n_parts, part_of()).sortWithinPartitions("at")), "segments")
    own = F.sort_array(F.collect_list(F.struct("at", "seq")))
    convos = pieces.groupBy("conv_id").agg(own.alias("parts"))
    convos = convos.select("conv_id", F.transform("parts", lambda p: F.struct(p["at"].alias("at"), F.length(p["seq"]).alias("size"))).alias("parts"), F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("seq"))
    convos = materialize(convos, "symbols")
    strings = materialize(convos.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "strings")
    judged = materialize(judge_strings(strings, learn_grammar(strings, most_rules)), "judged-strings")
    found = materialize(join_counted(convos, judged, "seq"), "judged")
    digests = repaired_digests(ordered, dealt_audits(found.select("conv_id", "parts", "seq", "audit")), n_parts)
    turns = ordered.groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("kinds"))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("kinds"), F.lit(0)).cast("long")
    out = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more in (turns.select("conv_id", gaps.alias("gaps")), found.drop("parts", "seq"), digests):
        out = out.alias("a").join(more.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select("a.*", *(F.col(f"b.{c}") for c in more.columns if c != "conv_id"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation."""
    return repair_conversations(read_table(spark, sf_dir, "conversations"))

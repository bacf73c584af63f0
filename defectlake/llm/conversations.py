"""Repair of conversation structure by a generalised LR parser with weighted edits.

Roles follow the grammar ``(s?(ua)+)?``: an optional system turn, then pairs of a user and an assistant turn, or nothing.
The parser keeps a graph-structured stack: stacks share what lies below their tops, and every turn extends each live top by
the edits that let the grammar shift it, with the reductions due before. Tops of the same state can go on alike, so they
merge, and the cheapest edits stay, the least audit of equal cost. A conversation is read once in order of its turns; a top
carries the running digest of its repaired text, so that memory does not grow with the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean_memory, staged

# Productions of the role grammar; c is a conversation, b a body of pairs, p a pair.
GRAMMAR = (("c", ""), ("c", "b"), ("c", "sb"), ("b", "bp"), ("b", "p"), ("p", "ua"))
TERMINALS, END = "sua", "$"
ROLES = {"u": b"user", "a": b"assistant"}  # that a turn may be given or inserted with

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3
BROADCAST_ROWS = 100_000
LINK_LETTERS = 1024

GAPS = " \t\n\x0b\x0c\r"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


class Automaton:
    """LR tables of a grammar whose start symbol is that of its first production; stacks are nested pairs (state, rest)."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = grammar
        self.rules = {head for head, _ in grammar}
        self.states: list[frozenset] = [self._closed({(None, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for i, state in enumerate(self.states):  # grows while it is walked
            for symbol in {self._next(item) for item in state} - {None}:
                target = self._closed({(rule, dot + 1) for rule, dot in state if self._next((rule, dot)) == symbol})
                if target not in self.states:
                    self.states.append(target)
                self.goto[i, symbol] = self.states.index(target)
        self.follow = self._follow()
        self.start = (0, None)
        self.known: dict = {}

    def _body(self, rule) -> str:
        return self.grammar[0][0] if rule is None else self.grammar[rule][1]

    def _next(self, item) -> str | None:
        rule, dot = item
        return self._body(rule)[dot] if dot < len(self._body(rule)) else None

    def _closed(self, items: set) -> frozenset:
        todo = list(items)
        while todo:
            symbol = self._next(todo.pop())
            new = {(i, 0) for i, (head, _) in enumerate(self.grammar) if head == symbol} - items
            items |= new
            todo += new
        return frozenset(items)

    def _first(self, symbol: str) -> set:
        seen, todo, out = set(), [symbol], set()
        while todo:
            s = todo.pop()
            if s not in self.rules:
                out.add(s)
            elif s not in seen:
                seen.add(s)
                todo += [body[0] for head, body in self.grammar if head == s and body]
        return out

    def _follow(self) -> dict[str, set]:
        """What may come after each nonterminal; only the start symbol may be empty here, and it stands in no body."""
        out = {head: set() for head in self.rules}
        out[self.grammar[0][0]] = {END}
        while True:
            before = sum(map(len, out.values()))
            for head, body in self.grammar:
                for symbol, after in zip(body, [*body[1:], None]):
                    if symbol in self.rules:
                        out[symbol] |= self._first(after) if after else out[head]
            if sum(map(len, out.values())) == before:
                return out

    def _reduced(self, stack, symbol: str) -> Iterator:
        """The stack and what it can be reduced to before ``symbol``."""
        yield stack
        for rule, dot in self.states[stack[0]]:
            if rule is not None and dot == len(self._body(rule)) and symbol in self.follow[self.grammar[rule][0]]:
                below = stack
                for _ in range(dot):
                    below = below[1]
                yield from self._reduced((self.goto[below[0], self.grammar[rule][0]], below), symbol)

    def shift(self, stack, symbol: str):
        """The stack after ``symbol``, or None; for the end, whether the stack is a whole conversation."""
        if (stack, symbol) not in self.known:
            tops = list(self._reduced(stack, symbol))
            if symbol == END:
                found = any((None, 1) in self.states[top[0]] for top in tops)
            else:
                found = next(((self.goto[top[0], symbol], top) for top in tops if (top[0], symbol) in self.goto), None)
            self.known[stack, symbol] = found
        return self.known[stack, symbol]


@dataclass(slots=True)
class Top:
    """A live top of the stack: cost, place among the tops in the order of their audits, audit and digest so far."""

    stack: tuple
    cost: int
    rank: int
    link: tuple | None  # earlier letters of the audit, shared by tops that agree in them
    letters: str
    digest: object
    some: bool


class Parser:
    """Repairs one conversation: ``turn`` for each turn in order, then ``close``."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.steps: dict = {}
        self.reset()

    def reset(self) -> None:
        self.tops = [Top(self.automaton.start, 0, 0, None, "", hashlib.sha256(), False)]

    def _steps(self, stack, initial: str, keep: bool) -> list[tuple]:
        """Edits of a turn as (stack after, cost, letters, roles of the lines to write); None is the turn's own role.

        An insertion belongs to the turn that follows it. Two before one turn are never cheapest, since the grammar lets
        a turn take either role after at most one.
        """
        key = (stack, initial, keep)
        if key not in self.steps:
            out, shift = [(stack, DELETE, "D", ())], self.automaton.shift
            if keep:
                ready = [(stack, 0, "", ())] + [(shift(stack, x), INSERT, "I", (ROLES[x],)) for x in ROLES]
                for before, cost, letters, lines in ready:
                    if before is not None:
                        if initial in TERMINALS and initial and (after := shift(before, initial)) is not None:
                            out.append((after, cost, letters + "K", (*lines, None)))
                        out += [(after, cost + REROLE, letters + "R", (*lines, ROLES[x])) for x in ROLES if (after := shift(before, x)) is not None]
            self.steps[key] = out
        return self.steps[key]

    def turn(self, role: bytes, text: bytes, fault: int) -> None:
        keep = fault not in (BLANK_FAULT, DUPLICATE_FAULT)
        extra = TRUNCATED if fault == TRUNCATED_FAULT else 0
        initial = role[:1].decode("latin-1")
        best: dict[int, tuple] = {}
        for top in self.tops:
            for stack, cost, letters, lines in self._steps(top.stack, initial, keep):
                found = (top.cost + cost + (extra if lines else 0), top.rank, letters)
                if stack[0] not in best or found < best[stack[0]][0]:
                    best[stack[0]] = (found, stack, lines, top)
        tops = []
        for rank, ((cost, _, letters), stack, lines, top) in enumerate(sorted(best.values(), key=lambda b: b[0][1:])):
            tops.append(self._moved(top, stack, cost, rank, letters, lines, role, text))
        self.tops = tops

    def _moved(self, top: Top, stack, cost: int, rank: int, letters: str, lines: tuple, role: bytes, text: bytes) -> Top:
        digest, some = top.digest, top.some
        if lines:
            digest = digest.copy()
            for i, line in enumerate(lines):
                last = i + 1 == len(lines)
                digest.update((b"\n" if some else b"") + (line or role) + b":")
                if last:
                    digest.update(text)
                some = True
        link, own = top.link, top.letters
        if len(own) >= LINK_LETTERS:
            # Tops that stem from this one share the link.
            top.link, top.letters = link, own = (link, own), ""
        return Top(stack, cost, rank, link, own + letters, digest, some)

    def close(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair; the parser is ready for another conversation."""
        best = None
        for top in self.tops:
            todo = [(top.stack, 0, "", ())]
            for stack, cost, letters, lines in todo:  # grows by insertions, at most as many as a pair has turns
                if self.automaton.shift(stack, END):
                    found = (top.cost + cost, top.rank, letters)
                    if best is None or found < best[0]:
                        best = (found, lines, top)
                elif len(letters) < len(ROLES):
                    todo += [(after, cost + INSERT, letters + "I", (*lines, ROLES[x])) for x in ROLES if (after := self.automaton.shift(stack, x)) is not None]
        (cost, _, letters), lines, top = best
        digest, some = top.digest.copy(), top.some
        for line in lines:
            digest.update((b"\n" if some else b"") + line + b":")
            some = True
        parts, link = [letters, top.letters], top.link
        while link:
            link, part = link
            parts.append(part)
        self.reset()
        return cost, "".join(reversed(parts)), digest.hexdigest()


def same_key() -> Column:
    """Digest of role and text, told apart by the length of the role."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def faulty_turns(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, dropped)`` with ``fault`` (0 none, 1 blank, 2 may be a duplicate, 3 truncated), ``early`` and ``same``.

    A turn whose role and text stand in several places of its conversation has the earliest turn of them in ``early``; the
    copies are counted before they meet, so that many of them are no burden.
    """
    words = F.rtrim(F.col("text"), F.lit(GAPS))
    fault = F.when(words == "", BLANK_FAULT).when(~F.substring(words, -1, 1).isin(".", "!", "?"), TRUNCATED_FAULT).otherwise(0)
    marked = rows.withColumn("fault", fault).withColumn("same", F.when((F.col("fault") != BLANK_FAULT) & ~F.col("dropped"), same_key()))
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    again = marked.filter("same is not null").groupBy("conv_id", "same").agg(F.count("*").alias("n"), F.min(order).alias("early")).filter("n > 1")
    again = staged(again.select(F.col("conv_id").alias("conv__"), F.col("same").alias("same__"), "early"), "repeats")
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    return marked.join(again, F.col("conv_id").eqNullSafe(F.col("conv__")) & (F.col("same") == F.col("same__")), "left").drop("conv__", "same__")


def _plain(rows: DataFrame) -> DataFrame:
    """The columns that are read, with their types; a null role or text is one space."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    value = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), value("role"), value("text"), F.coalesce(dropped, F.lit(False)).alias("dropped"))


def _turns(batches) -> Iterator[tuple]:
    """Rows of sorted batches as tuples, a few hundred at a time."""
    for batch in batches:
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in batch.columns]
        for i in range(0, batch.num_rows, 256):
            yield from zip(*(c.slice(i, 256).to_pylist() for c in columns))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text)``: its faults, the cheapest edits and the digest of its repair.

    Turns are taken by number, nulls first, of equal numbers by role and text. The first fault of a turn counts: blank (no
    character but white space), duplicate (role and text came earlier), truncated (the last such character is none of
    ``.!?``). ``illegal`` counts neighbours whose role initials are none of su, ua, au, and ``gaps`` missing turn numbers.
    ``audit`` has the edits in order: K keeps, R gives the role of user or assistant, D deletes, I inserts an empty turn;
    blank and duplicate turns are deleted. Null is a conversation of its own; a null role or text is one space, which
    no grammar takes. Rows may be marked ``dropped``: they only say that the conversation exists. Equal rows are
    duplicates, whichever comes first; columns of other names are not read. No rows give no rows.

    A conversation is one stream, since its digest depends on all of its text in order; its rows reach one task sorted by
    Spark, which holds some 1,000 letters for each top and the letters that all tops share, not its texts.
    """
    turns = faulty_turns(_plain(rows)).select("conv_id", "turn", "role", "text", "dropped", "fault", "early", "same")

    def run(batches):
        lean_memory()
        parser, names = Parser(Automaton()), [f.split()[0] for f in RESULT.split(", ")]
        types = [pa.int64()] * 7 + [pa.string()] * 2
        out, size = [], 0

        def done(state):
            conv, low, high, numbers, blank, duplicate, truncated, illegal = state
            return (conv, high - low + 1 - numbers if numbers else 0, blank, duplicate, truncated, illegal, *parser.close())

        state = last = initial = None
        started = False
        for conv, turn, role, text, dropped, fault, early, same in _turns(batches):
            if not started or conv != state[0]:
                if started:
                    out.append(done(state))
                    size += len(out[-1][7])
                    if len(out) >= 1000 or size >= 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, size = [], 0
                state, last, initial, started = [conv, None, None, 0, 0, 0, 0, 0], None, None, True
            if dropped:
                continue
            if turn is not None and turn != state[2]:
                state[1], state[2], state[3] = turn if state[1] is None else state[1], turn, state[3] + 1
            if fault != BLANK_FAULT and early is not None and ((turn is not None, turn) != (early["some"], early["turn"]) or last == (turn, same)):
                fault = DUPLICATE_FAULT
            last = (turn, same)
            if fault:
                state[3 + fault] += 1
            pair = role[:1]
            state[7] += initial is not None and initial + pair not in (b"su", b"ua", b"au")
            initial = pair
            parser.turn(role, text, fault)
        if started:
            out.append(done(state))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    streams = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return streams.mapInArrow(run, RESULT)


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: ``(conv_id, place, turn, role, text, edit)``, ``place`` from 0 in each conversation.

    ``repairs`` is what :func:`repair_conversations` returned for ``rows``. An inserted turn has no number and an empty
    text. The audit of a conversation goes before its turns in one sorted stream.
    """
    turns = _plain(rows).filter("not dropped").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    audits = repairs.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))

    def run(batches):
        lean_memory()
        automaton, names = Automaton(), [f.split()[0] for f in REPAIRED.split(", ")]
        types = [pa.int64()] * 3 + [pa.string()] * 3
        out, size, audit, at, place, conv = [], 0, "", 0, 0, None
        stack = automaton.start

        def inserted():
            nonlocal at, place, stack
            while at < len(audit) and audit[at] == "I":
                role = next(x for x in ROLES if automaton.shift(stack, x) is not None)
                stack = automaton.shift(stack, role)
                yield (conv, place, None, ROLES[role].decode(), "", "I")
                at, place = at + 1, place + 1

        for key, kind, turn, role, text in _turns(batches):
            if kind == 0:
                out += inserted()
                conv, audit, at, place, stack = key, text.decode(), 0, 0, automaton.start
                continue
            out += inserted()
            edit, at = audit[at], at + 1
            if edit != "D":
                new = role[:1].decode("latin-1") if edit == "K" else next(x for x in ROLES if automaton.shift(stack, x) is not None)
                stack = automaton.shift(stack, new)
                out.append((conv, place, turn, (role if edit == "K" else ROLES[new]).decode(), text.decode(), edit))
                place, size = place + 1, size + len(text)
            if len(out) >= 1000 or size >= 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, size = [], 0
        out += inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    streams = turns.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    return streams.mapInArrow(run, REPAIRED)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with planted damage by the checksum of ``conv_id:turn`` modulo 20, nulls as one space: 0 marks a
    row dropped, 1 empties its text, 2 takes away its stops, 3 repeats it and 4 gives it the role of user."""
    rows = _plain(conversations)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(code == 4, "user").otherwise(F.col("role"))
    copies = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (code == 0).alias("dropped"), F.explode(copies).alias("copy__")).drop("copy__")

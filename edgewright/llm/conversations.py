"""Conversation structure repair: cheapest edits that make a conversation's roles alternate, by dynamic programming over many conversations at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.llm.lines import WHITE
from edgewright.llm.shared import written

#: Costs of edits; a truncated row that is not deleted costs CUT more.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Rows of whole conversations that are worked on together, unless a single conversation is longer.
ROWS = 1 << 16

# States of a repaired conversation: nothing yet, after system, after user, after assistant. Roles: other, system, user, assistant.
_KEEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
#: The state that a row of the one fitting role, user or assistant, leads to.
_FIT = np.array([2, 2, 3, 2])
#: What is still to be inserted where the rows end.
_END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
_NAMES = [None, None, "user", "assistant"]
_NEVER = np.int64(1 << 60)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by a hash of their conversation and turn, as repair is tried on.

    Of 20 parts of the hash 0 drops a row (it stays as ``gone``), 1 empties its text, 2 takes its sentence ends, 3 repeats it and 4 makes it the user's.
    Null roles and texts become one space, as null ids do in the hash.
    """
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    part = F.crc32(F.concat(show("conv_id"), F.lit(":"), show("turn")).cast("binary")) % 20
    text = F.when(part == 1, "").when(part == 2, F.regexp_replace(show("text"), "[.!?]", "")).otherwise(show("text"))
    made = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(part == 4, "user").otherwise(show("role")).alias("role"), text.alias("text"), (part == 0).alias("gone"), part.alias("part"))
    return made.select("conv_id", "turn", "role", "text", "gone", F.explode(F.array_repeat(F.lit(0), F.when(F.col("part") == 3, 2).otherwise(1).cast("int")))).drop("col")


def _told(rows: DataFrame) -> DataFrame:
    """Rows with the digest of role and text that tells them apart and orders those of one turn."""
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def _edits(codes: np.ndarray, must: np.ndarray, cut: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs of n conversations, and their edits as bytes (n, steps), 0 for none; arrays are (turns, n).

    Costs from each turn on are kept for every state; then all conversations are traced side by side, each taking the letter that
    comes first in ASCII among those that still lead to its least cost.
    """
    turns, n = codes.shape
    each = np.arange(n)
    left = np.empty((turns + 1, 4, n), dtype=np.int64)
    left[turns] = _END[:, None]
    for t in range(turns - 1, -1, -1):
        ahead, extra = left[t + 1], CUT * cut[t]
        row = np.empty((4, n), dtype=np.int64)
        for s in range(4):
            to = _KEEP[s, codes[t]]
            keep = np.where((to >= 0) & ~must[t], extra + ahead[to, each], _NEVER)
            other = np.where(must[t], _NEVER, REROLE + extra + ahead[_FIT[s]])
            row[s] = np.minimum(np.minimum(keep, other), DELETE + ahead[s])
        once = np.minimum(row, INSERT + row[_FIT])
        best = np.minimum(once, 2 * INSERT + row[_FIT[_FIT]])
        left[t] = np.where(t < sizes, best, _END[:, None])
    steps = np.zeros((3 * turns + 2, n), dtype=np.uint8)
    state = np.zeros(n, dtype=np.int64)
    for t in range(turns):
        open_ = t < sizes
        for j in range(3):
            now = left[t][state, each]
            delete = open_ & (DELETE + left[t + 1][state, each] == now)
            insert = open_ & ~delete & (INSERT + left[t][_FIT[state], each] == now)
            to = _KEEP[state, codes[t]]
            keep = open_ & ~delete & ~insert & (to >= 0) & ~must[t] & (CUT * cut[t] + left[t + 1][to, each] == now)
            other = open_ & ~delete & ~insert & ~keep
            steps[3 * t + j] = np.select([delete, insert, keep, other], [ord("D"), ord("I"), ord("K"), ord("R")], 0)
            state = np.where(keep, to, np.where(insert | other, _FIT[state], state))
            open_ = insert
            if not open_.any():
                break
    for j in range(2):
        insert = _END[state] > 0
        steps[3 * turns + j] = np.where(insert, ord("I"), 0)
        state = np.where(insert, _FIT[state], state)
    return left[0, 0], steps.T


_AUDIT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audited(rows: pa.Table) -> pa.RecordBatch:
    """A row for each conversation of whole conversations' sorted rows (conv_id, turn, digest, initial, blank, cut, gone)."""
    conv = rows.column("conv_id").combine_chunks()
    begin = np.flatnonzero(_changes(conv))
    number = np.cumsum(_changes(conv)) - 1
    n = len(begin)
    here = ~rows.column("gone").to_numpy()
    number = number[here]
    turn = rows.column("turn").combine_chunks().filter(pa.array(here))
    known, value = pc.is_valid(turn).to_numpy(zero_copy_only=False), pc.fill_null(turn, 0).to_numpy()
    blank, cut = (rows.column(c).to_numpy()[here] for c in ("blank", "cut"))
    code = rows.column("initial").to_numpy()[here]
    digest = np.frombuffer(b"".join(rows.column("digest").filter(pa.array(here)).to_pylist()) or bytes(16), dtype="<u8").reshape(-1, 2)[: len(number)]
    # A row is a duplicate if its digest stands before it in its conversation.
    order = np.lexsort((digest[:, 1], digest[:, 0], number))  # stable: equal ones stay in order
    again = np.zeros(len(order), dtype=bool)
    again[order[1:]] = (digest[order[1:]] == digest[order[:-1]]).all(axis=1) & (number[order[1:]] == number[order[:-1]])
    again &= ~blank
    cut &= ~blank & ~again
    count = lambda on: np.bincount(number[on], minlength=n).astype(np.int64)
    same = number[1:] == number[:-1]
    pair = code[:-1].astype(np.int64) * 4 + code[1:]
    illegal = np.bincount(number[1:][same & ~np.isin(pair, [1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2])], minlength=n)
    gaps = np.zeros(n, dtype=np.int64)
    if known.any():
        v, of = value[known], number[known]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        last = np.append(first[1:], len(of)) - 1
        fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (v[1:] != v[:-1])])
        gaps[of[first]] = v[last] - v[first] + 1 - np.add.reduceat(fresh.astype(np.int64), first)
    sizes = np.bincount(number, minlength=n)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    cost, audits = np.zeros(n, dtype=np.int64), np.full(n, "", dtype=object)
    bucket = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for b in np.unique(bucket[sizes > 0]):
        of = np.flatnonzero((bucket == b) & (sizes > 0))
        turns = int(sizes[of].max())
        place = starts[of][None, :] + np.minimum(np.arange(turns)[:, None], sizes[of][None, :] - 1)
        cost[of], steps = _edits(code[place], (blank | again)[place], cut[place], sizes[of])
        text, ends = steps[steps > 0].tobytes().decode(), np.cumsum((steps > 0).sum(axis=1)).tolist()
        audits[of] = [text[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)]
    columns = [conv.take(pa.array(begin)), *(pa.array(x.astype(np.int64)) for x in (gaps, count(blank), count(again), count(cut), illegal, cost)), pa.array(audits.tolist(), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it, null equal to null."""
    new = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        new[1:] = ~pc.or_(pc.and_(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.equal(a, b), False)).to_numpy(zero_copy_only=False)
    return new


def _audit_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            rows = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes(rows.column(0).combine_chunks()))[-1])
            if last:  # the last conversation may go on
                yield _audited(rows.slice(0, last))
                rows = rows.slice(last)
            held = rows.combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        yield _audited(pa.Table.from_batches(held))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of (conv_id, turn, role, text, gone).

    Rows are taken by turn, nulls first, those of one turn by the digest of role and text. Each row's first fault counts: blank, a duplicate of role
    and text seen before, truncated. ``audit`` is the cheapest sequence of Keep, Rerole, Delete and Insert, by initials, that makes the roles an optional
    system turn and then whole pairs of user and assistant, or nothing; of equally cheap ones the least in ASCII.
    Only a digest and a few flags of each row meet by conversation, some 40 bytes, of which the audit is one: texts do not.

    Nulls: a null conv_id is a conversation of its own; a null turn comes first and makes no gap; roles and texts must not be null
    (``damaged`` fills them). Repeated rows are duplicates. An empty text is blank. A conversation whose rows are all ``gone`` has zeros
    and an empty audit. An empty table gives no rows. Other columns are left out, whatever their names.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    bare = F.btrim("text", F.lit(WHITE))
    initial = F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring("role", 1, 1)).cast("byte")
    light = _told(rows).select("conv_id", "turn", "digest", initial.alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), "gone")
    dealt = light.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest")
    return dealt.mapInArrow(_audit_stream, _AUDIT.format(id=kind))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of sorted rows (conv_id, turn, digest, role, text): a conversation's first row has its audit for text and no role."""
    audit, p, state, place, conv = "", 0, 0, 0, None

    for batch in batches:
        out: list[tuple] = []

        def give(edit: str, role: str, text: str) -> None:
            nonlocal place
            out.append((conv, place, edit, role, text))
            place += 1

        def inserts() -> None:
            nonlocal p, state
            while p < len(audit) and audit[p] == "I":
                p, state = p + 1, int(_FIT[state])
                give("I", _NAMES[state], "")

        for c, role, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if role is None:
                inserts()
                audit, p, state, place, conv = text, 0, 0, 0, c
                continue
            inserts()
            edit, p = audit[p], p + 1
            if edit == "K":
                state = int(_KEEP[state, "?sua".index(role[0])])
                give("K", role, text)
            elif edit == "R":
                state = int(_FIT[state])
                give("R", _NAMES[state], text)
        yield _turns(out, batch.schema.field(0).type)
    out = []
    while p < len(audit):  # what the last conversation still lacks
        p, state = p + 1, int(_FIT[state])
        out.append((conv, place, "I", _NAMES[state], ""))
        place += 1
    if out:
        yield _turns(out, batch.schema.field(0).type)


def _turns(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=["conv_id", "place", "edit", "role", "text"])


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of every conversation of ``rows`` after the edits of its audit, in order.

    Texts are sorted by conversation and streamed past their audit, so a long conversation needs no more memory than its audit.
    The rows of a conversation lie one behind the other in a partition.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = audited.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("binary").alias("digest"), none("string").alias("role"), F.col("audit").alias("text"))
    texts = _told(rows.where("not gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "role", "text")
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    return dealt.drop("kind").mapInArrow(_apply, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha, conv, done, kind = None, None, [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        for c, place, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
            if place == 0:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                sha, conv = hashlib.sha256(), c
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if done:
            yield _pairs(done, kind)
            done = []
    if sha is not None:
        yield _pairs([(conv, sha.hexdigest())], kind)


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])


def repair_digests(rows: DataFrame) -> DataFrame:
    """The audits of damaged rows, with the SHA-256 of each repaired conversation's ``role:text`` lines, which is that of no text where none is left."""
    made = damaged(rows)
    audited, _ = written(audits(made), "conversation-audits")
    digests = repaired(made, audited).mapInArrow(_digests, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    met = audited.alias("a").join(digests.alias("d"), F.col("a.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    return met.select("a.*", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))



def oracle() -> str:
    """The repair as SQL: states run forward over the rows, each with its least cost and audit and the lines so far; conversation ids are not null."""
    some = lambda x, cost, letter, lines: f"case when {x} is not null then {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {lines}}} end"
    more = lambda x, cost, letter, line: some(x, cost, letter, f"list_append({x}.t, {line})")
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    insert = lambda x, role: more(x, INSERT, "I", f"'{role}:'")
    stays = lambda x: some(x, DELETE, "D", f"{x}.t")
    keep = lambda x, role: f"case when not must and initial = '{role}' then {more(x, 'extra', 'K', 'line')} end"
    other = lambda x, role: f"case when not must then {more(x, f'{REROLE} + extra', 'R', f"'{role}:' || text")} end"
    users = least("s2", insert("s0", "user"), insert("s1", "user"), insert("s3", "user"))
    ends = least("s3", insert("u2", "assistant"))
    none = "null::struct(c integer, a varchar, t varchar[])"
    byte = "(case when i % 8 = 0 then xor(crc, ascii(k[i // 8 + 1])::bigint) else crc end)"
    return f"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
parts as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, range(0, 8 * length(k))), lambda crc, i: xor({byte} >> 1, 3988292384 * ({byte} & 1)))) % 20 as part from keyed),
hurt as (
  select conv_id, turn, case when part = 4 then 'user' else role end as role,
    case when part = 1 then '' when part = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case part when 0 then 0 when 3 then 2 else 1 end)) from parts),
bare as (
  select conv_id, turn, role, text, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare, md5(length(role)::varchar || ':' || role || text) as digest from hurt),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as n from bare),
told as (
  select *, bare = '' as blank, bare <> '' and row_number() over (partition by conv_id, role, text order by n) > 1 as again, left(role, 1) as initial,
    lag(left(role, 1)) over (partition by conv_id order by n) as before from placed),
faults as (select *, not blank and not again and right(bare, 1) not in ('.', '!', '?') as cut from told),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again) as duplicate,
    count(*) filter (where cut) as truncated, count(*) filter (where before || initial not in ('su', 'ua', 'au')) as illegal, max(n) as n from faults group by conv_id),
steps as (select conv_id, n, initial, text, role || ':' || text as line, blank or again as must, case when cut then {CUT} else 0 end as extra from faults),
walk as (
  select distinct conv_id, 0::bigint as n, {{'c': 0, 'a': '', 't': []::varchar[]}} as s0, {none} as s1, {none} as s2, {none} as s3 from steps
  union all
  select conv_id, n, {stays("s0")}, {least(stays("s1"), keep("s0", "s"))},
    {least(stays("u2"), keep("s0", "u"), keep("s1", "u"), keep("u3", "u"), other("s0", "user"), other("s1", "user"), other("u3", "user"))},
    {least(stays("u3"), keep("u2", "a"), other("u2", "assistant"))}
  from (select *, {ends} as u3 from (
    select w.conv_id, s.n, s.initial, s.text, s.line, s.must, s.extra, s0, s1, s3, {users} as u2 from walk w join steps s on s.conv_id = w.conv_id and s.n = w.n + 1))),
ended as (select conv_id, n, {least("s0", ends)} as e from (select conv_id, n, s0, s3, {users} as u2 from walk)),
every as (select distinct conv_id from conversations)
select v.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(e.e.c, 0)::bigint as cost, coalesce(e.e.a, '') as audit, sha256(coalesce(array_to_string(e.e.t, chr(10)), '')) as repaired_sha256
from every v left join sums s on s.conv_id = v.conv_id left join ended e on e.conv_id = s.conv_id and e.n = s.n"""

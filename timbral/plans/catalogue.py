"""Named queries over signal views of the tables, each written once for both SQL dialects.

Views: ``sig`` (stream, i, x) are the values of a user's events in order, as integers; ``blk`` are its
blocks of 16 samples, the last one of a stream as short as it comes, with the place p inside and the length n; ``stereo`` pairs the streams 2s and 2s + 1; ``vec`` are the
components of the embeddings; ``curve`` are the places of a floor curve, the distinct values mod 128 of a
stream's samples, each at its first one.  Windows are partitioned by stream, joins are on stream and place, so the
plans shuffle on the stream key only.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.checksums import crc_table

BLOCK = 16
DEPTH = 32
#: Bands of 20 ms frames in the CELT layer: fixed values, first bin of each band in units of 2.5 ms bins.
BAND_EDGES = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 34, 40, 48, 60, 78, 100)

QUERIES: dict[str, Callable] = {}


def _named(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def views(d) -> str:
    b = lambda e: f"cast({e} as bigint)"
    array = "posexplode(embedding)" if d.name == "spark" else None
    vec = f"select vec_id, j, cast(v as double) as v from (select vec_id, {array} as (j, v) from embeddings)" if array else "select vec_id, j - 1 as j, cast(embedding[j] as double) as v from embeddings cross join unnest(generate_series(1, 64)) t(j)"
    return f"""with sig as {d.once}(select user_id as stream, {b("row_number() over (partition by user_id order by event_id)")} - 1 as i, {b("round(value * 100)")} as x from events),
blk as {d.once}(select stream, {d.div("i", str(BLOCK))} as block, i % {BLOCK} as p, x, count(*) over (partition by stream, {d.div("i", str(BLOCK))}) as n from sig),
stereo as {d.once}(select {d.div("a.stream", "2")} as stream, a.i as i, a.x as l, b.x as r from sig a join sig b on b.stream = a.stream + 1 and b.i = a.i where a.stream % 2 = 0),
curve as {d.once}(select stream, min(i) as i, x from (select stream, i, x % 128 as x from sig) q group by stream, x),
vec as ({vec})
"""


def _lags(order: int, key: str = "stream", place: str = "i", x: str = "x") -> str:
    """The finite difference of this order, inside a partition."""
    terms = {0: "{0}", 1: "{0} - {1}", 2: "{0} - 2 * {1} + {2}", 3: "{0} - 3 * {1} + 3 * {2} - {3}", 4: "{0} - 4 * {1} + 6 * {2} - 4 * {3} + {4}"}[order]
    return terms.format(x, *(f"lag({x}, {k}) over (partition by {key} order by {place})" for k in range(1, order + 1)))


def fold(d, e: str) -> str:
    """Zigzag: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return d.xor(f"2 * ({e})", f"case when ({e}) < 0 then -1 else 0 end")


def width(d, e: str) -> str:
    """Bits of a signed number, 0 for zero."""
    return f"case when {e} = 0 then 0 when {e} = -1 then 1 else {d.bits(f'case when {e} < 0 then -({e}) - 1 else {e} end')} + 1 end"


for _k in range(5):
    QUERIES[f"fixed_residual_o{_k}"] = lambda d, k=_k: f"select stream, i, r from (select stream, i, {_lags(k)} as r from sig) q where i >= {k}"


@_named
def fixed_restore_o2(d):
    return """select stream, i, cast(sum(s) over (partition by stream order by i) as bigint) as x from
    (select stream, i, sum(r) over (partition by stream order by i) as s from (select stream, i, x - 2 * coalesce(lag(x, 1) over (partition by stream order by i), 0)
    + coalesce(lag(x, 2) over (partition by stream order by i), 0) as r from sig) q) q2"""


@_named
def zigzag_fold(d):
    return f"select stream, i, {fold(d, 'r')} as f from (select stream, i, {_lags(1)} as r from sig) q where i >= 1"


@_named
def zigzag_unfold(d):
    return f"select stream, i, {d.xor(d.shr('f', '1'), '-(f % 2)')} as r from (select stream, i, {fold(d, 'x - 25000')} as f from sig) q"


def _rice(d, rows: str, keys: str) -> str:
    """Best Rice parameter and its cost for the folded residuals f of each group: the first least cost of the
    parameters within two of the bit length of the mean.  Spark sums the shifted residuals of all 31 parameters in one
    pass; the other dialect costs each candidate by a join."""
    if d.name == "spark":
        sums = ", ".join(f"sum(shiftright(f, {k}))" for k in range(31))
        best = "array_min(transform(sequence(greatest(e - 2, 0L), least(e + 2, 30L)), k -> named_struct('bits', s[cast(k as int)] + c * (1 + k), 'k', k)))"
        return f"""select {keys}, best.k as k, best.bits as bits from (select {keys}, {best} as best from
        (select {keys}, s, c, cast(case when m = 0 then 0 else length(bin(m)) end as bigint) as e from
        (select {keys}, array({sums}) as s, count(*) as c, cast(sum(f) as bigint) div count(*) as m from ({rows}) r0 group by {keys}) m0) e0) b0"""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    mean = d.div("cast(sum(f) as bigint)", "count(*)")
    e = f"case when m = 0 then 0 else {d.bits('case when m = 0 then 1 else m end')} end"
    return f"""select {keys}, k, bits from (select *, row_number() over (partition by {keys} order by bits, k) as rk from
    (select {", ".join("a." + k for k in keys.split(", "))}, k, cast(sum({d.shr("f", "k")} + 1 + k) as bigint) as bits from ({rows}) a join
    (select {keys}, k from (select {keys}, {e} as e from (select {keys}, {mean} as m from ({rows}) r0 group by {keys}) m0) e0{d.series("greatest(e - 2, 0)", "least(e + 2, 30)", "ks", "k")}) b on {on}
    group by {", ".join("a." + k for k in keys.split(", "))}, k) c0) c1 where rk = 1"""


@_named
def rice_best_param(d):
    return _rice(d, f"select stream, {fold(d, 'r')} as f from (select stream, i, {_lags(1)} as r from sig) q where i >= 1", "stream")


@_named
def escape_width(d):
    return f"select stream, block, cast(max({width(d, 'x - 25000')}) as bigint) as bits from blk group by stream, block"


def _parts(d) -> str:
    """Residuals (here the centred samples) of each partition of each partition order 0 to 3 that divides the block."""
    return f"select stream, block, po, {d.div('p', d.shr('n', 'po'))} as part, x - 25000 as r from blk{d.series('0', '3', 'pos', 'po')} where n % {d.shl('1', 'po')} = 0"


def _plans(d) -> str:
    rice = _rice(d, f"select stream, block, po, part, {fold(d, 'r')} as f from ({_parts(d)}) q", "stream, block, po, part")
    escape = f"select stream, block, po, part, count(*) * max({width(d, 'r')}) + 9 as raw from ({_parts(d)}) q group by stream, block, po, part"
    return f"""select r.stream, r.block, r.po, r.part, case when bits + 4 <= raw then k else -1 end as param, cast(least(bits + 4, raw) as bigint) as cost
    from ({rice}) r join ({escape}) e on r.stream = e.stream and r.block = e.block and r.po = e.po and r.part = e.part"""


@_named
def partition_plan(d):
    return _plans(d)


@_named
def partition_best_order(d):
    return f"""select stream, block, po, cost from (select *, row_number() over (partition by stream, block order by cost, po) as rk from
    (select stream, block, po, cast(sum(cost) as bigint) as cost from ({_plans(d)}) q group by stream, block, po) q2) q3 where rk = 1"""


def _fixed(d) -> str:
    """Cost of each fixed predictor on each block, with one Rice partition.  Spark takes the five residuals in one pass."""
    if d.name == "spark":
        each = ", ".join(f"named_struct('o', {k}, 'r', {_lags(k, 'stream, block', 'p')})" for k in range(5))
        rows = f"select stream, block, a.o as o, {fold(d, 'a.r')} as f from (select stream, block, p, explode(rs) as a from (select stream, block, p, array({each}) as rs from blk) w) q where p >= a.o"
        return f"select stream, block, cast(o as bigint) as o, bits + 4 + 6 + o * {DEPTH} as cost from ({_rice(d, rows, 'stream, block, o')}) q"
    rows = " union all ".join(f"select stream, block, {k} as o, {fold(d, 'r')} as f from (select stream, block, p, {_lags(k, 'stream, block', 'p')} as r from blk) q{k} where p >= {k}" for k in range(5))
    return f"select stream, block, cast(o as bigint) as o, bits + 4 + 6 + o * {DEPTH} as cost from ({_rice(d, rows, 'stream, block, o')}) q"


@_named
def best_fixed_order(d):
    return f"select stream, block, o, cost from (select *, row_number() over (partition by stream, block order by cost, o) as rk from ({_fixed(d)}) q) q2 where rk = 1"


@_named
def subframe_kind(d):
    return f"""select b.stream, b.block, case when lo = hi then 'constant' when cost < n * {DEPTH} then 'fixed' else 'verbatim' end as kind
    from (select stream, block, min(x) as lo, max(x) as hi, count(*) as n from blk group by stream, block) b
    join (select stream, block, min(cost) as cost from ({_fixed(d)}) q group by stream, block) f on b.stream = f.stream and b.block = f.block"""


@_named
def wasted_bits(d):
    return "select stream, block, cast(case when o = 0 then 0 else bit_count((o & -o) - 1) end as bigint) as wasted from (select stream, block, bit_or(x) as o from blk group by stream, block) q"


@_named
def is_constant(d):
    return "select stream, block, min(x) = max(x) as constant from blk group by stream, block"


@_named
def mid_side_roundtrip(d):
    """Left and right from mid and side; the side's parity gives back the bit that the mid lost."""
    return f"""select stream, i, {d.shr("2 * m + abs(s % 2) + s", "1")} as l, {d.shr("2 * m + abs(s % 2) - s", "1")} as r from
    (select stream, i, {d.shr("l + r", "1")} as m, l - r as s from stereo) q"""


@_named
def interleave(d):
    return f"select stream, 2 * i + c as pos, case when c = 0 then l else r end as x from stereo{d.series('0', '1', 'cs', 'c')}"


@_named
def deinterleave(d):
    return f"select stream, i % 2 as channel, {d.div('i', '2')} as frame, x from sig"


@_named
def int_to_float(d):
    return "select stream, i, round(cast(x - 25000 as double) / 32768, 6) + 0.0 as s from sig"


@_named
def float_to_int_clamped(d):
    return "select stream, i, cast(least(greatest(round(cast(x - 25000 as double) / 20000 * 32768), -32768), 32767) as bigint) as s from sig"


@_named
def wav_u8_bias(d):
    return "select stream, i, x % 256 - 128 as s from sig"


@_named
def frame_counts(d):
    return "select stream, count(*) as frames, min(i) = 0 and max(i) = count(*) - 1 as gapless from sig group by stream"


@_named
def autocorrelation(d):
    """Spark takes the lags in one window; the other dialect joins the samples with themselves."""
    if d.name == "spark":
        sums = ", ".join(f"{k}L, cast(sum(x * x{k}) as bigint)" for k in range(5))
        past = ", ".join(f"lag(x, {k}) over (partition by stream order by i) as x{k}" for k in range(5))
        return f"select stream, k, r from (select stream, stack(5, {sums}) as (k, r) from (select stream, x, {past} from (select stream, i, x - 25000 as x from sig) q) q2 group by stream) q3 where r is not null"
    return f"""select stream, k, cast(sum((a_x - 25000) * (b_x - 25000)) as bigint) as r from
    (select a.stream as stream, a.k as k, a.x as a_x, b.x as b_x from (select stream, i, x, k from sig{d.series("0", "4", "ks", "k")}) a
    join sig b on a.stream = b.stream and b.i = a.i - a.k) q group by stream, k"""


@_named
def levinson_order2(d):
    """Two steps of the recursion, from integer autocorrelations."""
    r = " , ".join(f"cast(sum(case when k = {k} then r end) as double) as r{k}" for k in range(3))
    return f"""select stream, round(k1 * (1 - k2), 6) + 0.0 as a1, round(k2, 6) + 0.0 as a2, round(e1 * (1 - k2 * k2) / r0, 6) + 0.0 as err from
    (select *, (r2 - k1 * r1) / e1 as k2 from (select *, r1 / r0 as k1, r0 * (1 - r1 / r0 * r1 / r0) as e1 from (select stream, {r} from ({QUERIES["autocorrelation"](d)}) q group by stream) q2 where r0 > 0) q3) q4 where e1 > 0"""


@_named
def lpc_residual(d):
    """Second-order predictor with fixed integer coefficients and a shift of 4."""
    lag = lambda k: f"lag(x, {k}) over (partition by stream order by i)"
    return f"select stream, i, r from (select stream, i, x - {d.shr(f'29 * {lag(1)} - 13 * {lag(2)}', '4')} as r from sig) q where i >= 2"


@_named
def vorbis_window(d):
    return f"select distinct p, round(sin(pi() / 2 * pow(sin((p + 0.5) / {BLOCK} * pi()), 2)), 6) + 0.0 as w from blk"


def _basis(n: int, k: str, j: str) -> str:
    return f"cos(pi() / {n} * ({j} + 0.5 + {n} / 2.0) * ({k} + 0.5))"


def _spectrum(d, n: int = 32) -> str:
    return f"select vec_id, k, sum(v * {_basis(n, 'k', 'j')}) * 2 / {n} as c from vec{d.series('0', str(n - 1), 'ks', 'k')} group by vec_id, k"


@_named
def mdct_forward(d):
    return f"select vec_id, k, round(c, 4) + 0.0 as c from ({_spectrum(d)}) q"


@_named
def mdct_inverse(d):
    return f"select vec_id, j, round(sum(c * {_basis(32, 'k', 'j')}), 4) + 0.0 as y from ({_spectrum(d)}) q{d.series('0', '63', 'js', 'j')} group by vec_id, j"


@_named
def overlap_add(d):
    """Blocks of 16 that start every 8 samples add up where they overlap."""
    return "select stream, 8 * block + p as pos, cast(sum(x) as bigint) as x from blk group by stream, 8 * block + p"


@_named
def page_lacing(d):
    n = "octet_length(encode(text, 'utf-8'))" if d.name == "spark" else "octet_length(encode(text))"
    return f"select doc_id, k, case when k < {d.div('n', '255')} then cast(255 as bigint) else cast(n % 255 as bigint) end as lace from (select doc_id, {n} as n from documents) q{d.series('0', d.div('n', '255'), 'ks', 'k')}"


#: Sequence numbers in a range.  A serial's pages are ordered by ranges, each a task's work, so a serial may be of any size.
RANGE = 4096


def _totals_before(rows: str, place: str, amount: str) -> str:
    """Spark SQL: the rows and, as ``before``, the sum of an amount over those before them in their serial.  That is the
    sum inside the row's range plus the totals of the ranges before it, of which there is a row a range."""
    earlier = "rows between unbounded preceding and 1 preceding"
    parted = f"(select *, seq div {RANGE} as part from ({rows}) q)"
    inside = f"select *, coalesce(sum({amount}) over (partition by serial, part order by {place} {earlier}), 0) as inside from {parted} q"
    totals = f"select serial, part, sum({amount}) as total from {parted} q group by serial, part"
    outside = f"select serial as of_serial, part as of_part, coalesce(sum(total) over (partition by serial order by part {earlier}), 0) as outside from ({totals}) q"
    return f"select *, inside + outside as before from ({inside}) a join ({outside}) b on a.serial <=> b.of_serial and a.part <=> b.of_part"


@_named
def packet_reassembly(d):
    """Packets from lacing values: a value under 255 ends one."""
    if d.name == "spark":
        laces = f"select doc_id % 4 as serial, doc_id as seq, k, lace from ({page_lacing(d)}) q"
        numbered = _totals_before(laces, "seq, k", "case when lace < 255 then 1 else 0 end")
        return f"select serial, cast(before as bigint) as packet, min(seq) as first_doc, cast(sum(lace) as bigint) as size, count(*) as segments from ({numbered}) q2 group by serial, before"
    return f"""select serial, cast(packet as bigint) as packet, min(seq) as first_doc, cast(sum(lace) as bigint) as size, count(*) as segments from
    (select serial, seq, k, lace, coalesce(sum(case when lace < 255 then 1 else 0 end) over (partition by serial order by seq, k rows between unbounded preceding and 1 preceding), 0) as packet
    from (select doc_id % 4 as serial, doc_id as seq, k, lace from ({page_lacing(d)}) q) q2) q3 group by serial, packet"""


def _gaps(d) -> str:
    return f"select event_id % 4 as serial, {d.div('event_id', '4')} as seq from events where event_id % 7 <> 3"


@_named
def sequence_holes(d):
    if d.name == "spark":
        parted = f"(select *, seq div {RANGE} as part from ({_gaps(d)}) q)"
        inside = f"select *, lag(seq) over (partition by serial, part order by seq) as near from {parted} q"
        outside = f"select serial as of_serial, part as of_part, lag(last) over (partition by serial order by part) as far from (select serial, part, max(seq) as last from {parted} q group by serial, part) q"
        found = f"select serial, seq, coalesce(near, far) as before from ({inside}) a join ({outside}) b on a.serial <=> b.of_serial and a.part <=> b.of_part"
        return f"select serial, seq, seq - before - 1 as missing from ({found}) q2 where seq <> before + 1"
    return f"select serial, seq, seq - before - 1 as missing from (select serial, seq, lag(seq) over (partition by serial order by seq) as before from ({_gaps(d)}) q) q2 where seq <> before + 1"


@_named
def hole_runs(d):
    """Runs of pages without a gap."""
    if d.name == "spark":
        return f"select serial, min(seq) as first_seq, max(seq) as last_seq, count(*) as pages from ({_totals_before(_gaps(d), 'seq', '1')}) q2 group by serial, seq - before"
    return f"""select serial, min(seq) as first_seq, max(seq) as last_seq, count(*) as pages from (select serial, seq, seq - row_number() over (partition by serial order by seq) as island from ({_gaps(d)}) q) q2 group by serial, island"""


@_named
def granule_trim(d):
    """Samples that stay of each block when a stream's granule says that it ends 5 samples early."""
    return f"""select stream, block, greatest(0, least(n, last - {BLOCK} * block)) as kept from
    (select distinct stream, block, n, max({BLOCK} * block + n) over (partition by stream) - 5 as last from blk) q"""


def _crc_query(bits: int) -> Callable:
    """A CRC without reflection or final flip over all bytes of each text: a byte enters at the top of the register,
    and the table holds what eight shifts make of it.  An empty text keeps the start value 0."""

    def query(d):
        if bits == 32 and d.name == "spark":
            return f"select doc_id, {d.crc32_forward('text')} as crc from documents"
        at = d.xor(d.shr("c", str(bits - 8)), "b")
        step = d.xor(f"(c * 256) % {1 << bits}", d.pick(crc_table(bits), at))
        return f"select doc_id, {d.fold_bytes('text', '0', step)} as crc from documents"

    return query


QUERIES["crc8"] = _crc_query(8)
QUERIES["crc16"] = _crc_query(16)
QUERIES["crc32_ogg"] = _crc_query(32)


def _tags(d) -> str:
    return f"select page_id as id, split_part(t, '=', 1) as name, substring(t, length(split_part(t, '=', 1)) + 2) as val, t from pages{d.split_pairs('url', 'ts', 't')} where url like '%?%'"


@_named
def tags_get(d):
    return f"select id, val from ({_tags(d)}) q where lower(name) = lower('UTM_Source')"


@_named
def tags_first(d):
    return f"select p.page_id as id, coalesce(min(q.t), '') as first_tag, count(q.t) as tags from pages p left join ({_tags(d)}) q on q.id = p.page_id group by p.page_id"


@_named
def toc_config(d):
    """Mode, bandwidth and frame duration of each of the 32 configurations of an Opus packet's first byte."""
    c = d.shr("event_id % 256", "3")
    return f"""select event_id, config, case when config < 12 then 'silk' when config < 16 then 'hybrid' else 'celt' end as mode,
    case when config < 4 then 'narrow' when config < 8 then 'medium' when config < 12 then 'wide' when config < 14 then 'superwide' when config < 16 then 'full'
    when config < 20 then 'narrow' when config < 24 then 'wide' when config < 28 then 'superwide' else 'full' end as bandwidth,
    case when config < 12 then case config % 4 when 0 then 10000000 when 1 then 20000000 when 2 then 40000000 else 60000000 end
    when config < 16 then case config % 2 when 0 then 10000000 else 20000000 end
    else case config % 4 when 0 then 2500000 when 1 then 5000000 when 2 then 10000000 else 20000000 end end as duration_ns
    from (select event_id, {c} as config from events) q"""


@_named
def toc_survey(d):
    return f"select mode, bandwidth, duration_ns, count(*) as packets from ({toc_config(d)}) q group by mode, bandwidth, duration_ns"


@_named
def opus_frame_length(d):
    """Length field: one byte under 252, else the second byte times four more."""
    return f"select event_id, case when b1 < 252 then b1 else 4 * b2 + b1 end as size, cast(case when b1 < 252 then 1 else 2 end as bigint) as taken from (select event_id, event_id % 256 as b1, {d.div('event_id', '256')} % 256 as b2 from events) q"


@_named
def coded_number_len(d):
    """Bytes of the UTF-8-like form of a frame number."""
    return "select stream, i, case when v < 128 then 1 when v < 2048 then 2 when v < 65536 then 3 when v < 2097152 then 4 when v < 67108864 then 5 when v < 2147483648 then 6 else 7 end as bytes from (select stream, i, x * x as v from sig) q"


@_named
def float32_unpack(d):
    """Packed float: sign bit, ten bits of exponent with bias 788, 21 bits of mantissa."""
    v = "(event_id * 2654435761) % 4294967296"
    e = f"{d.shr('w', '21')} % 16 + 770"
    return f"select event_id, round((case when w >= 2147483648 then -1 else 1 end) * (w % 2097152) * pow(2.0, ({e}) - 788), 6) + 0.0 as f from (select event_id, {v} as w from events) q"


@_named
def lookup1_values(d):
    """The largest n whose power does not exceed the entries."""
    power = lambda n: f"{n} * {n} * case when dim = 3 then {n} else 1 end"
    return f"select entries, dim, max(n) as n from (select distinct x % 1000 + 1 as entries, x % 2 + 2 as dim from sig) q{d.series('1', '32', 'ns', 'n')} where {power('n')} <= entries group by entries, dim"


@_named
def kraft_sum(d):
    """Is a code of these lengths complete: do the powers of two add up to one (in units of 2^-16)?"""
    return f"select stream, cast(sum({d.shl('1', '16 - (x % 8 + 1)')}) as bigint) as kraft, sum({d.shl('1', '16 - (x % 8 + 1)')}) = 65536 as complete from sig group by stream"


@_named
def huffman_flat_lengths(d):
    """A balanced complete code: as many leaves as can be on the shallower of two levels, first."""
    h = d.bits("n")
    return f"""select n, entry, case when entry < {d.shl("1", "h")} - n then cast(h - 1 as bigint) else cast(h as bigint) end as len from (select n, case when n = 1 then 1 else {d.bits("n - 1")} end as h from
    (select distinct x % 60 + 2 as n from sig) q) q2{d.series("0", "n - 1", "es", "entry")}"""


@_named
def floor_neighbors(d):
    """Nearest smaller and larger place among those that come earlier."""
    return f"""select a.stream, a.i, a.x, max(case when b.x < a.x then b.x end) as low, min(case when b.x > a.x then b.x end) as high
    from curve a join curve b on a.stream = b.stream and b.i <= a.i group by a.stream, a.i, a.x"""


@_named
def render_point(d):
    """Height of the line between the outer samples of each block, truncated, at each place."""
    return f"""select stream, block, p, y0 + case when y1 < y0 then -{d.div("(y0 - y1) * p", "greatest(n - 1, 1)")} else {d.div("(y1 - y0) * p", "greatest(n - 1, 1)")} end as y from
    (select stream, block, p, n, first_value(x) over (partition by stream, block order by p) as y0, last_value(x) over (partition by stream, block order by p rows between unbounded preceding and unbounded following) as y1 from blk) q"""


@_named
def inverse_coupling(d):
    """Magnitude and angle to two channels."""
    return """select stream, i, case when m > 0 then case when a > 0 then m else m + a end else case when a > 0 then m else m - a end end as l,
    case when m > 0 then case when a > 0 then m - a else m end else case when a > 0 then m + a else m end end as r from (select stream, i, l - 25000 as m, r - 25000 as a from stereo) q"""


@_named
def residue_accumulate(d):
    """Passes add vectors of four values to the places they stand at."""
    return f"select stream, 4 * (x % 16) + c as pos, cast(sum(x % 7 - 3) as bigint) as v from sig{d.series('0', '3', 'cs', 'c')} group by stream, 4 * (x % 16) + c"


@_named
def pvq_count(d):
    """V(n, k), the number of vectors of n whole numbers whose magnitudes add up to k, for n and k to 8:
    choose the j places that are not zero, their signs, and a composition of k into j parts."""
    numbers = " union all ".join(f"select {n} as m" for n in range(9))
    factorial = " ".join(f"when {n} then {f}" for n, f in enumerate((1, 1, 2, 6, 24, 120, 720, 5040, 40320)))
    fact = lambda e: f"(case {e} {factorial} end)"
    choose = lambda n, k: f"({d.div(fact(n), fact(k) + ' * ' + fact(f'({n} - {k})'))})"
    return f"""select n, k, cast(sum({choose("n", "j")} * {d.shl("1", "j")} * {choose("(k - 1)", "(j - 1)")}) as bigint) as v from
    (select a.m as n, b.m as k, c.m as j from ({numbers}) a join ({numbers}) b on b.m >= 1 join ({numbers}) c on c.m >= 1 and c.m <= a.m and c.m <= b.m where a.m >= 1) q group by n, k"""


@_named
def band_energy(d):
    """Energy of the bands that cover the 64 components of each vector; the last band ends with them."""
    bands = " union all ".join(f"select {i} as band, {a} as lo, {min(b, 64)} as hi" for i, (a, b) in enumerate(zip(BAND_EDGES[:-1], BAND_EDGES[1:], strict=True)) if a < 64)
    return f"select vec_id, band, round(sqrt(sum(v * v) + 1e-27), 5) + 0.0 as amp from vec join ({bands}) b on j >= lo and j < hi group by vec_id, band"


@_named
def lcg_noise(d):
    """Next state of the noise generator from each state."""
    return "select event_id, (1664525 * (event_id * 65537 % 4294967296) + 1013904223) % 4294967296 as next from events"


@_named
def pitch_lag(d):
    """The lag of 2 to 8 with the largest squared correlation by energy, positive correlations only.  Spark takes the
    lags in one window."""
    if d.name == "spark":
        sums = ", ".join(f"{k}L, cast(sum(x * x{k}) as double), cast(sum(x{k} * x{k}) as double) + 1" for k in range(2, 9))
        past = ", ".join(f"lag(x, {k}) over (partition by stream order by i) as x{k}" for k in range(2, 9))
        each = f"select stream, stack(7, {sums}) as (k, c, e) from (select stream, x, {past} from (select stream, i, x - 25000 as x from sig) q) q2 group by stream"
        return f"select stream, best.k as k from (select stream, min(named_struct('v', -(c * c / e), 'k', k)) as best from ({each}) q3 where c > 0 group by stream) q4"
    return f"""select stream, k from (select stream, k, row_number() over (partition by stream order by c * c / e desc, k) as rk from
    (select a.stream as stream, a.k as k, cast(sum((a.x - 25000) * (b.x - 25000)) as double) as c, cast(sum((b.x - 25000) * (b.x - 25000)) as double) + 1 as e
    from (select stream, i, x, k from sig{d.series("2", "8", "ks", "k")}) a join sig b on a.stream = b.stream and b.i = a.i - a.k group by a.stream, a.k) q where c > 0) q2 where rk = 1"""

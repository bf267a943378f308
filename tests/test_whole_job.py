"""Queries on tables of their own, against brute force: no sample, block or byte of the input is left out."""

import duckdb
import pytest

from timbral import plans


@pytest.fixture
def answers(spark, tmp_path):
    """Rows of a query over small tables, in Spark and of its SQL in DuckDB, which must be the same."""

    def run(name, texts=(), samples=(), vectors=()):
        rows = {
            "documents": ([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"),
            "events": ([(n, s, x / 100) for n, (s, x) in enumerate(samples)], "event_id bigint, user_id bigint, value double"),
            "embeddings": (list(enumerate(vectors)), "vec_id bigint, embedding array<float>"),
            "pages": ([], "page_id bigint, url string, html string"),
        }
        con = duckdb.connect()
        for table, (values, schema) in rows.items():
            spark.createDataFrame(values, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"create or replace view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        frame = plans.queries()[name](spark, str(tmp_path))
        got = sorted(tuple(r) for r in frame.collect())
        assert got == sorted(con.execute(f"select {', '.join(frame.columns)} from ({plans.oracle_sql()[name]})").fetchall())
        return got

    return run


def brute_crc(data: bytes, poly: int, bits: int) -> int:
    r = 0
    for byte in data:
        for k in range(7, -1, -1):
            out = r >> (bits - 1) & 1
            r = (r << 1) % (1 << bits) ^ poly * (out ^ byte >> k & 1)
    return r


@pytest.mark.parametrize(("name", "poly", "bits"), [("crc8", 0x07, 8), ("crc16", 0x8005, 16), ("crc32_ogg", 0x04C11DB7, 32)])
def test_checksums_fold_every_byte(answers, name, poly, bits):
    texts = ["", "a", "x" * 32, "x" * 32 + "y", "x" * 32 + "z", "x" * 31 + "éß日本", "lorem ipsum " * 400]
    assert answers(name, texts) == [(i, brute_crc(t.encode(), poly, bits)) for i, t in enumerate(texts)]


def test_floor_neighbors_take_every_place(answers):
    xs = [(37 * n * n + 11 * n) % 1000 for n in range(60)]
    places, want = [], []
    for i, x in enumerate(v % 128 for v in xs):
        if x not in places:
            places.append(x)
            want.append((7, i, x, max((p for p in places if p < x), default=None), min((p for p in places if p > x), default=None)))
    assert len(want) > 12 and answers("floor_neighbors", samples=[(7, x) for x in xs]) == want


def blocks(x: list[int]) -> list[list[int]]:
    return [x[at : at + 16] for at in range(0, len(x), 16)]


def brute_rice(r: list[int]) -> tuple[int, int]:
    """(bits, parameter)"""
    f = [2 * v if v >= 0 else -2 * v - 1 for v in r]
    e = (sum(f) // len(f)).bit_length()
    return min((sum((v >> k) + 1 + k for v in f), k) for k in range(max(e - 2, 0), min(e + 2, 30) + 1))


def brute_width(r: list[int]) -> int:
    return max(0 if v == 0 else (v if v > 0 else -v - 1).bit_length() + 1 for v in r)


def brute_plan(b: list[int]) -> list[tuple[int, int, int, int]]:
    """(partition order, partition, parameter or -1, cost)"""
    out = []
    for po in range(4):
        if len(b) % (1 << po) == 0:
            size = len(b) >> po
            for part in range(1 << po):
                r = [v - 25000 for v in b[part * size : part * size + size]]
                (bits, k), raw = brute_rice(r), size * brute_width(r) + 9
                out.append((po, part, k if bits + 4 <= raw else -1, min(bits + 4, raw)))
    return out


def brute_order(b: list[int]) -> tuple[int, int]:
    """(partition order, cost)"""
    plan = brute_plan(b)
    return min(((po, sum(c for o, _, _, c in plan if o == po)) for po in {p[0] for p in plan}), key=lambda x: x[::-1])


def brute_fixed(b: list[int]) -> tuple[int, int]:
    """(predictor order, cost)"""
    costs, r = [], b
    for o in range(min(5, len(b))):
        costs.append((brute_rice(r)[0] + 10 + 32 * o, o))
        r = [v - u for u, v in zip(r, r[1:])]
    return min(costs)[::-1]


def brute_kind(b: list[int]) -> str:
    return "constant" if len(set(b)) == 1 else "fixed" if brute_fixed(b)[1] < 32 * len(b) else "verbatim"


def brute_wasted(b: list[int]) -> int:
    return min(((v & -v).bit_length() - 1 for v in b if v), default=0)


def brute_line(b: list[int]) -> list[tuple[int, int]]:
    step = b[-1] - b[0]
    off = lambda p: abs(step) * p // max(len(b) - 1, 1)
    return [(p, b[0] - off(p) if step < 0 else b[0] + off(p)) for p in range(len(b))]


PER_BLOCK = {
    "escape_width": lambda b: [(brute_width([v - 25000 for v in b]),)],
    "partition_plan": brute_plan,
    "partition_best_order": lambda b: [brute_order(b)],
    "best_fixed_order": lambda b: [brute_fixed(b)],
    "subframe_kind": lambda b: [(brute_kind(b),)],
    "wasted_bits": lambda b: [(brute_wasted(b),)],
    "is_constant": lambda b: [(len(set(b)) == 1,)],
    "render_point": brute_line,
}
STREAMS = {
    2: [25000 + (n * n * 37 + n) % 900 - 450 for n in range(66)],
    3: [25000 + 8 * n for n in range(28)],
    4: [24000, 25010, 25000, 25500, 24992],
    5: [25007],
    6: [7 * n % 16 + 25000 for n in range(16)],
    7: [(1 << 31) - 5, 17, 9 - (1 << 31)],
}
SAMPLES = [(s, x) for s, xs in STREAMS.items() for x in xs]


@pytest.mark.parametrize("name", sorted(PER_BLOCK))
def test_short_last_blocks(answers, name):
    want = [(s, n, *row) for s, xs in STREAMS.items() for n, b in enumerate(blocks(xs)) for row in PER_BLOCK[name](b)]
    assert answers(name, samples=SAMPLES) == sorted(want)


def test_overlap_add_adds_short_blocks(answers):
    sums = {}
    for s, xs in STREAMS.items():
        for n, b in enumerate(blocks(xs)):
            for p, x in enumerate(b):
                sums[s, 8 * n + p] = sums.get((s, 8 * n + p), 0) + x
    assert answers("overlap_add", samples=SAMPLES) == sorted((*k, v) for k, v in sums.items())


def test_granule_trim_ends_by_the_true_length(answers):
    want = [(s, n, max(0, min(len(b), len(xs) - 5 - 16 * n))) for s, xs in STREAMS.items() for n, b in enumerate(blocks(xs))]
    assert sum(k for s, _, k in want if s == 2) == 61 and answers("granule_trim", samples=SAMPLES) == sorted(want)


def test_band_energy_covers_every_component(answers):
    rows = answers("band_energy", vectors=[[3.0] * 64, [0.0] * 60 + [1.0, 2.0, 2.0, 4.0]])
    assert abs(sum(amp * amp for v, _, amp in rows if v == 0) - 9 * 64) < 1e-2
    assert [(band, amp) for v, band, amp in rows if v == 1 and amp > 0] == [(19, 5.0)]

"""The few places where Spark SQL and DuckDB SQL say the same thing in other words."""

from __future__ import annotations


class Spark:
    name = "spark"
    once = ""

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    @staticmethod
    def xor(a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))"

    @staticmethod
    def shl(a: str, n: str) -> str:
        return f"shiftleft(cast({a} as bigint), cast({n} as int))"

    @staticmethod
    def shr(a: str, n: str) -> str:
        return f"shiftright(cast({a} as bigint), cast({n} as int))"

    @staticmethod
    def series(lo: str, hi: str, table: str, column: str) -> str:
        """A lateral table of the whole numbers lo to hi, joined to what stands before it."""
        return f" lateral view explode(sequence(cast({lo} as bigint), cast({hi} as bigint))) {table} as {column}"

    @staticmethod
    def bits(a: str) -> str:
        """Binary digits of a number from 1 on."""
        return f"length(bin({a}))"

    @staticmethod
    def fold_bytes(text: str, start: str, step: str) -> str:
        """Fold ``step`` (of state c and byte b) over all bytes of a text; the start value for an empty one."""
        # bound to a name, the bytes are encoded once a text and not once a byte
        byte = "cast(conv(hex(substring(t, p, 1)), 16, 10) as bigint)"
        places = "case when octet_length(t) > 0 then sequence(1, octet_length(t)) when t is not null then cast(array() as array<int>) end"
        return f"transform(array(encode({text}, 'utf-8')), t -> aggregate(transform({places}, p -> {byte}), cast({start} as bigint), (c, b) -> {step}))[0]"

    @staticmethod
    def crc32_forward(text: str) -> str:
        """The CRC-32 that takes high bits first, from 0 and without a final flip.  It is the built-in CRC, which takes low
        bits first, of bytes with their bits turned round, less that of as many zero bytes, turned round again."""
        nibbles = f"translate(hex(encode({text}, 'utf-8')), '0123456789ABCDEF', '084C2A6E195D3B7F')"
        turned = f"unhex(regexp_replace({nibbles}, '(.)(.)', '$2$1'))"
        return f"cast(conv(reverse(lpad(bin(crc32({turned}) ^ crc32(unhex(repeat('00', octet_length({text}))))), 32, '0')), 2, 10) as bigint)"

    @staticmethod
    def pick(values: list[int], at: str) -> str:
        """The value at a place, counted from 0, of fixed ones."""
        return f"array({', '.join(f'{v}L' for v in values)})[cast({at} as int)]"

    @staticmethod
    def md5_joined(item: str, order: str) -> str:
        return f"md5(array_join(transform(array_sort(collect_list(struct({order} as o, {item} as v))), s -> s.v), ','))"

    @staticmethod
    def split_pairs(url: str, table: str, column: str) -> str:
        return f" lateral view explode(split(split({url}, '[?]')[1], '&')) {table} as {column}"


class Duck:
    name = "duck"
    once = "materialized "

    @staticmethod
    def div(a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    @staticmethod
    def xor(a: str, b: str) -> str:
        return f"xor(cast({a} as bigint), cast({b} as bigint))"

    @staticmethod
    def shl(a: str, n: str) -> str:
        return f"(cast({a} as bigint) * cast(pow(2, {n}) as bigint))"

    @staticmethod
    def shr(a: str, n: str) -> str:
        return f"(cast({a} as bigint) >> cast({n} as int))"

    @staticmethod
    def series(lo: str, hi: str, table: str, column: str) -> str:
        return f" cross join unnest(generate_series(cast({lo} as bigint), cast({hi} as bigint))) {table}({column})"

    @staticmethod
    def bits(a: str) -> str:
        return f"length(bin({a}))"

    @staticmethod
    def fold_bytes(text: str, start: str, step: str) -> str:
        # pairs of hex digits, cut in one pass
        codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: cast(('0x' || p) as bigint))"
        return f"list_reduce({codes}, lambda c, b: {step}, cast({start} as bigint))"

    @staticmethod
    def pick(values: list[int], at: str) -> str:
        return f"cast([{', '.join(map(str, values))}][{at} + 1] as bigint)"

    @staticmethod
    def md5_joined(item: str, order: str) -> str:
        return f"md5(string_agg({item}, ',' order by {order}))"

    @staticmethod
    def split_pairs(url: str, table: str, column: str) -> str:
        return f" cross join unnest(string_split(string_split({url}, '?')[2], '&')) {table}({column})"

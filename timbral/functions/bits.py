"""Bit cursors for packed binary formats: values grow from the low bit (``Low``) or from the high bit (``High``)
of each byte.  Both are backed by one Python integer, so a field of any width is a shift and a mask."""

from __future__ import annotations


class EndOfData(ValueError):
    """A field reaches past the end of its packet."""


class _Cursor:
    def __init__(self, data: bytes):
        self.size, self.at = 8 * len(data), 0
        self.data = data

    @property
    def left(self) -> int:
        return self.size - self.at

    def skip(self, n: int) -> None:
        if n > self.left:
            self.at = self.size
            raise EndOfData(f"{n} bits wanted at {self.at} of {self.size}")
        self.at += n

    def align(self) -> None:
        self.at = min(-(-self.at // 8) * 8, self.size)

    def take(self, n: int) -> bytes:
        """Whole bytes from a byte boundary."""
        if self.at % 8:
            raise ValueError("not at a byte boundary")
        at = self.at // 8
        self.skip(8 * n)
        return self.data[at : at + n]

    def flag(self) -> bool:
        return bool(self.read(1))

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if n and v >> (n - 1) else v


class Low(_Cursor):
    def read(self, n: int) -> int:
        at = self.at
        self.skip(n)
        first, last = at // 8, (at + n + 7) // 8
        return int.from_bytes(self.data[first:last], "little") >> (at % 8) & ((1 << n) - 1)

    def peek(self, n: int) -> tuple[int, int]:
        """(the next n bits, with zeros past the end; how many of them are there)."""
        first = self.at // 8
        v = int.from_bytes(self.data[first : (self.at + n + 7) // 8], "little") >> (self.at % 8)
        return v & ((1 << n) - 1), min(n, self.left)


class High(_Cursor):
    def read(self, n: int) -> int:
        at = self.at
        self.skip(n)
        last = (at + n + 7) // 8
        return int.from_bytes(self.data[at // 8 : last], "big") >> (8 * last - at - n) & ((1 << n) - 1)

    def unary(self, limit: int) -> int:
        """Zeros before the next one."""
        n, step = 0, 64
        while True:
            width = min(step, self.left)
            if not width:
                raise EndOfData("no end of a unary number")
            v = self.read(width)
            if v:
                zeros = width - v.bit_length()
                self.at -= width - zeros - 1
                n += zeros
                break
            n += width
        if n > limit:
            raise ValueError(f"unary number over {limit}")
        return n


class LowWriter:
    def __init__(self):
        self.value = self.bits = 0

    def write(self, v: int, n: int) -> None:
        self.value |= (v & ((1 << n) - 1)) << self.bits
        self.bits += n

    def align(self) -> None:
        self.bits = -(-self.bits // 8) * 8

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.bits // 8), "little")


class HighWriter:
    """Fields gather as digits of a bit string, which is turned into bytes once."""

    def __init__(self):
        self.parts: list[str] = []
        self.bits = 0

    def write(self, v: int, n: int) -> None:
        if n:
            self.parts.append(format(v & ((1 << n) - 1), f"0{n}b"))
            self.bits += n

    def digits(self, text: str) -> None:
        self.parts.append(text)
        self.bits += len(text)

    def unary(self, n: int) -> None:
        self.digits("0" * n + "1")

    def align(self) -> None:
        self.digits("0" * (-self.bits % 8))

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big")

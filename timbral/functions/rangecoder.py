"""The range coder of Opus: symbols come from the front of a packet, raw bits from its end.

The decoder follows RFC 6716, section 4.1: a 32-bit range, byte-wise renormalisation, zeros past the end."""

from __future__ import annotations

TOP, BOTTOM = 1 << 31, 1 << 23
_MASK = (1 << 32) - 1


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)
        self.front = self.back = 0
        self.window = self.window_bits = 0
        self.range, self.bits = 128, 9
        self.last = self._byte()
        self.value = 127 - (self.last >> 1)
        self._fill()

    def _byte(self) -> int:
        self.front += 1
        return self.data[self.front - 1] if self.front <= self.size else 0

    def _fill(self) -> None:
        while self.range <= BOTTOM:
            self.bits += 8
            self.range <<= 8
            pair = self.last << 8
            self.last = self._byte()
            symbol = (pair | self.last) >> 1 & 255
            self.value = (self.value << 8) + (255 & ~symbol) & (TOP - 1)

    def frequency(self, total: int) -> int:
        """Which of ``total`` equal parts the value is in."""
        self.part = self.range // total
        return total - min(self.value // self.part + 1, total)

    def update(self, low: int, high: int, total: int) -> None:
        s = self.part * (total - high)
        self.value -= s
        self.range = self.part * (high - low) if low else self.range - s
        self._fill()

    def bit(self, log_p: int) -> bool:
        """A flag that is set with chance 2^-log_p."""
        s = self.range >> log_p
        found = self.value < s
        if found:
            self.range = s
        else:
            self.value -= s
            self.range -= s
        self._fill()
        return found

    def symbol(self, icdf: tuple[int, ...], bits: int) -> int:
        """A symbol whose chances of what lies above it are icdf / 2^bits."""
        part, s, k = self.range >> bits, self.range, -1
        while True:
            k += 1
            above, s = s, part * icdf[k]
            if self.value >= s:
                break
        self.value -= s
        self.range = above - s
        self._fill()
        return k

    def raw(self, n: int) -> int:
        """Bits from the end of the packet, low ones first."""
        while self.window_bits < n:
            self.back += 1
            self.window |= (self.data[self.size - self.back] if self.back <= self.size else 0) << self.window_bits
            self.window_bits += 8
        v = self.window & ((1 << n) - 1)
        self.window >>= n
        self.window_bits -= n
        self.bits += n
        return v

    def uniform(self, total: int) -> int:
        """A number under ``total``; large ones end in raw bits, and a broken one is the largest."""
        low = max((total - 1).bit_length() - 8, 0)
        high = (total - 1 >> low) + 1
        v = self.frequency(high)
        self.update(v, v + 1, high)
        v = v << low | self.raw(low)
        return min(v, total - 1)

    def skip_to(self, bits: int) -> None:
        """Count so many bits as used without reading any."""
        self.bits += max(bits - self.tell(), 0)

    def shrink(self, n: int) -> None:
        """Leave the last n bytes to another decoder: raw bits come from before them."""
        self.size -= min(max(n, 0), self.size)

    def tell(self) -> int:
        """Bits used so far, rounded up."""
        return self.bits - self.range.bit_length()

    def tell_eighths(self) -> int:
        """Eighths of bits used so far, rounded up: the logarithm of the range by repeated squaring."""
        length = self.range.bit_length()
        r, out = self.range >> length - 16, length
        for _ in range(3):
            r = r * r >> 15
            b = r >> 16
            out = out * 2 + b
            r >>= b
        return 8 * self.bits - out


class Encoder:
    """The inverse, for tests and round trips."""

    def __init__(self):
        self.low, self.range, self.raws, self.out = 0, TOP, [], bytearray()
        self.shifts = 0

    def update(self, low: int, high: int, total: int) -> None:
        part = self.range // total
        if low:
            self.low += self.range - part * (total - low)
            self.range = part * (high - low)
        else:
            self.range -= part * (total - high)
        while self.range <= BOTTOM:
            self.low <<= 8
            self.range <<= 8
            self.shifts += 1

    def bit(self, value: bool, log_p: int) -> None:
        s = self.range >> log_p
        if value:
            self.low += self.range - s
            self.range = s
        else:
            self.range -= s
        while self.range <= BOTTOM:
            self.low <<= 8
            self.range <<= 8
            self.shifts += 1

    def symbol(self, k: int, icdf: tuple[int, ...], bits: int) -> None:
        part = self.range >> bits
        if k:
            self.low += self.range - part * icdf[k - 1]
            self.range = part * (icdf[k - 1] - icdf[k])
        else:
            self.range -= part * icdf[k]
        while self.range <= BOTTOM:
            self.low <<= 8
            self.range <<= 8
            self.shifts += 1

    def raw(self, v: int, n: int) -> None:
        self.raws.append((v, n))

    def uniform(self, v: int, total: int) -> None:
        low = max((total - 1).bit_length() - 8, 0)
        high = (total - 1 >> low) + 1
        self.update(v >> low, (v >> low) + 1, high)
        self.raw(v & ((1 << low) - 1), low)

    def bytes(self, size: int | None = None) -> bytes:
        """Front bytes with as many digits of the interval as tell it apart, raw bits from the end."""
        width = 31 + 8 * self.shifts
        zeros = max(self.range.bit_length() - 1, 0)
        while zeros and ((self.low + (1 << zeros) - 1 >> zeros << zeros) + (1 << zeros) > self.low + self.range):
            zeros -= 1
        value = self.low + (1 << zeros) - 1 >> zeros << zeros
        front = (value << (-width % 8)).to_bytes(-(-width // 8), "big")
        back = at = 0
        for v, n in self.raws:
            back |= v << at
            at += n
        tail = back.to_bytes(-(-at // 8), "little")[::-1]
        total = size or len(front) + len(tail)
        return front + bytes(total - len(front) - len(tail)) + tail

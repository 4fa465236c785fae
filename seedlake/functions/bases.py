"""Scalar functions on bases, k-mers, keys and positions, as Column expressions.

Bases are upper-case text over ACGTN. A 32-mer key is kept as text (its order is the key's order); numeric forms are
DECIMAL(20,0), which holds any unsigned 64-bit number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = 32
#: base = 'ACGT'[code point mod 4] for the code points 1 to 127; anything else is N.
CODES = "".join(map(chr, range(1, 128)))
CODE_BASES = "".join("ACGT"[c % 4] for c in range(1, 128))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_text(text: Column | str) -> Column:
    """Any text as bases, one for each character; beyond ASCII: N. Null stays null."""
    return F.regexp_replace(F.translate(_c(text), CODES, CODE_BASES), "[^ACGT]", "N")


def fill_n(seq: Column | str, by: str = "A") -> Column:
    """Bases as the indexed text has them: everything but ACGT is `by`."""
    return F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", by)


def base_code(base: Column | str) -> Column:
    """0 to 3 for A, C, G, T in either case, else null."""
    return F.when(F.upper(_c(base)).isin(*"ACGT"), F.position(F.upper(_c(base)), F.lit("ACGT")) - 1)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_c(seq), "ACGT", "TGCA"))


def doubled(seq: Column | str) -> Column:
    """Forward strand, then its reverse complement; the end marker is implied (a proper prefix sorts first)."""
    return F.concat(_c(seq), reverse_complement(seq))


def tokenize(seq: Column | str, size: Column | int = KEY) -> Column:
    """The 32-mer key of a sequence's first bases: at most `size` of them, filled up with T."""
    n = F.least(F.lit(size) if isinstance(size, int) else size, F.lit(KEY))
    return F.rpad(F.left(_c(seq), n), KEY, "T")


def key_number(kmer: Column | str) -> Column:
    """The unsigned value of a k-mer of up to 32 bases, two bits a base, as DECIMAL(20,0)."""
    digits = F.translate(_c(kmer), "ACGT", "0123")
    high = F.conv(F.left(digits, F.greatest(F.length(digits) - 16, F.lit(0))), 4, 10)
    low = F.conv(F.right(digits, F.least(F.length(digits), F.lit(16))), 4, 10)
    return (F.coalesce(high.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(20,0)") + low.cast("decimal(20,0)")).cast("decimal(20,0)")


def key_long(seq: Column | str, by: str = "A") -> Column:
    """The first 32 bases, filled up with `by`, as a signed number in the order of the bases: two bits a base, the first bit turned."""
    digits = F.translate(F.rpad(_c(seq).cast("string"), KEY, by), "ACGT", "0123")
    half = lambda i: F.conv(F.substr(digits, F.lit(i), F.lit(16)), 4, 10).cast("long")
    return F.shiftleft(half(1) - (1 << 31), 32).bitwiseOR(half(17))


def hex32(key: Column | str) -> Column:
    """A key_long() as 16 hex digits of its unsigned value."""
    return F.lpad(F.lower(F.hex(_c(key).bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")


def key_text(number: Column | str, size: int = KEY) -> Column:
    """The k-mer of an unsigned value (DECIMAL or BIGINT)."""
    n = _c(number).cast("decimal(20,0)")
    wide = F.lit(1 << 32).cast("decimal(20,0)")
    part = lambda x: F.lpad(F.conv(x.cast("string"), 10, 4), 16, "0")
    digits = F.concat(part(F.floor(n / wide).cast("decimal(20,0)")), part((n % wide).cast("decimal(20,0)")))
    return F.translate(F.right(digits, F.lit(size)), "0123", "ACGT")


def reverse_complement_key(kmer: Column | str, size: Column | int) -> Column:
    """The key of the reverse complement of a key's first `size` bases; of none of them, all T."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.rpad(reverse_complement(F.left(_c(kmer), n)), KEY, "T")


def canonical(kmer: Column | str) -> Column:
    return F.least(_c(kmer), reverse_complement(kmer))


def lex_index(kmer: Column | str) -> Column:
    """The place of a k-mer of at most 31 bases among all of its length."""
    return F.conv(F.translate(_c(kmer), "ACGT", "0123"), 4, 10).cast("long")


def next_n(seq: Column | str, at: Column) -> Column:
    """How many bases from place `at` (from 0) to the next N or the end."""
    return F.position(F.lit("N"), F.concat(_c(seq), F.lit("N")), at + 1) - (at + 1)


def windows(seq: Column | str, k: int) -> Column:
    """All k-mers of a sequence in order, those with N too; none under k bases. Bytes, so that each costs the same."""
    b = _c(seq).cast("binary")
    n = F.length(_c(seq))
    return F.transform(F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substr(b, i, F.lit(k)).cast("string"))


def rolling_keys(seq: Column | str) -> Column:
    """The key at every place, those near the end filled up with T."""
    b = F.concat(_c(seq), F.lit("T" * (KEY - 1))).cast("binary")
    n = F.length(_c(seq))
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(b, i, F.lit(KEY)).cast("string"))


def minimizer(seq: Column | str, k: int = KEY) -> Column:
    """struct(kmer, at): the smallest k-mer without N and its first place (from 0); null if there is none."""
    pairs = F.transform(windows(seq, k), lambda w, i: F.struct(w.alias("kmer"), i.alias("at")))
    return F.array_min(F.filter(pairs, lambda x: ~F.contains(x.kmer, F.lit("N"))))


def doubled_base_at(seq: Column | str, at: Column) -> Column:
    """The base at a doubled place; null at or past the end marker."""
    return F.nullif(F.substr(doubled(seq), at + 1, F.lit(1)), F.lit(""))


def base_at(seq: Column | str, at: Column) -> Column:
    return F.when(at >= 0, F.nullif(F.substr(_c(seq), at + 1, F.lit(1)), F.lit("")))


def pack_position(at: Column | str) -> Column:
    """40 bits as 5 bytes: the high 32 bits little-endian, then the low byte."""
    hexed = F.lpad(F.hex(_c(at)), 10, "0")
    return F.unhex(F.concat(*[F.substr(hexed, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1, 9)]))


def unpack_position(packed: Column | str) -> Column:
    hexed = F.hex(_c(packed))
    return F.conv(F.concat(*[F.substr(hexed, F.lit(i), F.lit(2)) for i in (7, 5, 3, 1, 9)]), 16, 10).cast("long")


def prior_weight(freq: Column, base: float = 1.0) -> Column:
    """base + log2(1 + freq); no frequency counts as 0."""
    return F.lit(base) + F.log2(1 + F.coalesce(freq, F.lit(0)).cast("double"))


def clamp_to_int(value: Column, most: Column | int) -> Column:
    """Cut off to a whole number within 0 and `most`; NaN is 0."""
    top = (F.lit(most) if isinstance(most, int) else most).cast("double")
    return F.floor(F.greatest(F.lit(0.0), F.least(top, F.nanvl(value, F.lit(0.0))))).cast("long")


def encode_fallback(start: Column, size: Column) -> Column:
    """Where a leaf's second layer lies, in one signed 64-bit number: bit 63 set, 31 bits start, 32 bits size."""
    return F.lit(-(1 << 63)).bitwiseOR(F.shiftleft(start.cast("long"), 32)).bitwiseOR(size.cast("long"))


def decode_fallback(err: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(err, 32).bitwiseAND(F.lit(0x7FFFFFFF)), err.bitwiseAND(F.lit(0xFFFFFFFF))


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """The length of the common prefix of two byte strings, up to `most`: blocks of falling powers of two are compared."""
    sizes = F.array(*[F.lit(1 << bit) for bit in range(max(0, most.bit_length() - 1), -1, -1)])

    def step(at: Column, size: Column) -> Column:
        x = F.substr(a, at + 1, size)
        return at + F.when((F.octet_length(x) == size) & (x == F.substr(b, at + 1, size)), size).otherwise(0)

    return F.aggregate(sizes, F.lit(0), step)

"""Big-endian numbers and tables out of binary columns, without Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uint(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned number of 1 to 7 bytes at a place counted from 0; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at.cast("int") + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


def int32(data: Column, at: Column | int) -> Column:
    n = uint(data, at, 4)
    return F.when(n >= 2**31, n - 2**32).otherwise(n)


def rows(data: Column, at: int, count: Column, fields: tuple[int, ...], signed: tuple[int, ...] = ()) -> Column:
    """Array of structs f0, f1, ... from `count` fixed-width rows at a place; null where they do not fit."""
    width = sum(fields)

    def row(k: Column) -> Column:
        out, place = [], 0
        for i, size in enumerate(fields):
            get = int32(data, F.lit(at) + k * width + place) if i in signed else uint(data, F.lit(at) + k * width + place, size)
            out.append(get.alias(f"f{i}"))
            place += size
        return F.struct(*out)

    # an empty sequence cannot be written as bounds, so counts of 0 have a case of their own
    some = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1), row)
    return F.when(F.octet_length(data) >= F.lit(at) + count * width, F.when(count > 0, some).otherwise(F.slice(some, 1, 0)))


def adts_header(frame: Column, object_type: Column, rate_index: Column, channels: Column) -> Column:
    """Seven bytes in hex before an AAC frame; null where the frame is too long or a field does not fit."""
    n = F.octet_length(frame) + 7
    bits = F.lit(0xFFF1).cast("bigint") * 2**40
    bits = bits + (object_type - 1).cast("bigint") * 2**38 + rate_index.cast("bigint") * 2**34 + F.shiftright(channels, 2).cast("bigint") * 2**32
    bits = bits + (channels % 4).cast("bigint") * 2**30 + n.cast("bigint") * 2**13 + F.lit(0x7FF).cast("bigint") * 4
    good = (n <= 0x1FFF) & object_type.between(1, 4) & rate_index.between(0, 12) & channels.between(1, 7)
    return F.when(good, F.lpad(F.hex(bits), 14, "0"))


def nal_units(data: Column, size: int = 4) -> Column:
    """Array of structs offset, length, type from length-prefixed units; null where a length leads beyond the end.

    Each step reads the next length, so the walk is a fold over as many steps as units could fit.
    """
    empty = F.array().cast("array<struct<offset:int,length:bigint,type:int>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("units"), F.lit(True).alias("good"))
    total = F.octet_length(data)

    def step(s: Column, _: Column) -> Column:
        n = uint(data, s["at"], size)
        ok = n.isNotNull() & (n > 0) & (s["at"] + size + n <= total)
        unit = F.struct((s["at"] + size).cast("int").alias("offset"), n.alias("length"), uint(data, s["at"] + size, 1).bitwiseAND(31).cast("int").alias("type"))
        done = s["at"] >= total
        return F.when(done | ~s["good"], s).otherwise(F.struct(F.when(ok, s["at"] + size + n).otherwise(s["at"]).alias("at"), F.when(ok, F.array_append(s["units"], unit)).otherwise(s["units"]).alias("units"), F.coalesce(ok, F.lit(False)).alias("good")))

    steps = F.sequence(F.lit(0), F.greatest((total / (size + 1)).cast("int"), F.lit(0)))
    return F.aggregate(steps, start, step, lambda s: F.when(s["good"] & (s["at"] >= total), s["units"]))


def annex_b(data: Column, size: int = 4) -> Column:
    """Units with start codes for lengths; null where the lengths do not lead to the end."""
    code = F.unhex(F.lit("00000001"))
    units = nal_units(data, size)
    joined = F.aggregate(units, F.lit(b"").cast("binary"), lambda a, u: F.concat(a, code, F.substring(data, u["offset"] + 1, u["length"].cast("int"))))
    return F.when(units.isNotNull(), joined)


def bits(data: Column, at: int, size: int) -> Column:
    """Unsigned number of up to 24 bits that starts at a bit; null beyond the end."""
    first, last = at // 8, (at + size - 1) // 8
    return F.shiftright(uint(data, first, last - first + 1), 8 * (last + 1) - at - size).bitwiseAND((1 << size) - 1)


#: Sampling rates by index, AC-3 rates, channels by mode, and bit rates in kb/s.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
AC3_RATES, AC3_CHANNELS = (48000, 44100, 32000), (2, 1, 2, 3, 3, 4, 4, 5)
AC3_KBPS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)


def _nth(values: tuple[int, ...], k: Column) -> Column:
    return F.when(k.between(0, len(values) - 1), F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int") + 1))


def aac_config(data: Column) -> Column:
    """Struct object_type, rate_index, sample_rate, channels of an audio configuration; a written-out rate has index 15."""
    escaped = bits(data, 0, 5) == 31
    kind = F.when(escaped, bits(data, 5, 6) + 32).otherwise(bits(data, 0, 5))
    index = F.when(escaped, bits(data, 11, 4)).otherwise(bits(data, 5, 4))
    written = index == 15
    rate = F.when(written, F.when(escaped, bits(data, 15, 24)).otherwise(bits(data, 9, 24))).otherwise(_nth(AAC_RATES, index))
    channels = F.when(written, F.when(escaped, bits(data, 39, 4)).otherwise(bits(data, 33, 4))).otherwise(F.when(escaped, bits(data, 15, 4)).otherwise(bits(data, 9, 4)))
    return F.struct(kind.cast("int").alias("object_type"), index.cast("int").alias("rate_index"), rate.cast("bigint").alias("sample_rate"), channels.cast("int").alias("channels"))


def ac3_config(data: Column) -> Column:
    """Struct sample_rate, channels, kbps, bsid of a dac3 box; null parts where a code is reserved."""
    return F.struct(_nth(AC3_RATES, bits(data, 0, 2)).alias("sample_rate"), (_nth(AC3_CHANNELS, bits(data, 10, 3)) + bits(data, 13, 1)).cast("int").alias("channels"), _nth(AC3_KBPS, bits(data, 14, 5)).alias("kbps"), bits(data, 2, 5).cast("int").alias("bsid"))


#: Half rates of E-AC-3, blocks by code, DTS rates and bit rates by code, and channels by arrangement.
HALF_RATES, EAC3_BLOCKS = (24000, 22050, 16000), (1, 2, 3, 6)
DTS_RATES = (None, 8000, 16000, 32000, None, None, 11025, 22050, 44100, None, None, 12000, 24000, 48000, None, None)
DTS_CHANNELS = (1, 2, 2, 2, 2, 3, 3, 4, 4, 5, 6, 6, 6, 7, 8, 8)


def eac3_header(frame: Column) -> Column:
    """Struct frame_type, substream, frame_bytes, sample_rate, blocks, channels of an E-AC-3 frame; null without its sync word.

    A rate code of 3 means half of a second code's rate, and always six blocks.
    """
    half = bits(frame, 32, 2) == 3
    rate = F.when(half, _nth(HALF_RATES, bits(frame, 34, 2))).otherwise(_nth(AC3_RATES, bits(frame, 32, 2)))
    blocks = F.when(half, 6).otherwise(_nth(EAC3_BLOCKS, bits(frame, 34, 2)))
    channels = _nth(AC3_CHANNELS, bits(frame, 36, 3)) + bits(frame, 39, 1)
    made = F.struct(bits(frame, 16, 2).cast("int").alias("frame_type"), bits(frame, 18, 3).cast("int").alias("substream"), ((bits(frame, 21, 11) + 1) * 2).cast("int").alias("frame_bytes"), rate.cast("int").alias("sample_rate"), blocks.cast("int").alias("blocks"), channels.cast("int").alias("channels"))
    return F.when((bits(frame, 0, 16) == 0x0B77) & bits(frame, 32, 8).isNotNull(), made)


def dts_header(frame: Column) -> Column:
    """Struct blocks, frame_bytes, arrangement, sample_rate, lfe, channels of a DTS core frame; null without its sync word or cut short."""
    lfe = bits(frame, 85, 2) > 0
    rate = F.element_at(F.array(*[F.lit(v).cast("int") for v in DTS_RATES]), bits(frame, 66, 4).cast("int") + 1)
    made = F.struct((bits(frame, 39, 7) + 1).cast("int").alias("blocks"), (bits(frame, 46, 14) + 1).cast("int").alias("frame_bytes"), bits(frame, 60, 6).cast("int").alias("arrangement"), rate.alias("sample_rate"), lfe.alias("lfe"), (_nth(DTS_CHANNELS, bits(frame, 60, 6)) + lfe.cast("int")).cast("int").alias("channels"))
    return F.when((uint(frame, 0, 4) == 0x7FFE8001) & (F.octet_length(frame) >= 12), made)

"""Queries of operators.formats, operators.captions, operators.frames, functions.binary, sources.sidecars and streaming, over inputs made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import timing
from ..operators import captions as C
from ..operators import formats as O
from ..operators import frames as P
from ..operators import markers as R
from ..operators import packets as K
from ..sources import adapters as A
from ..sources import made as M
from ..sources import sidecars as S
from ..streaming import planner
from . import chunk_queries
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

#: Cues with a text of letters, digits and spaces, and even times.
_SAID = "said AS (SELECT track, ix, rtrim('T' || ix || ' ' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g')) AS t, ix * 2000 + track % 7 * 100 AS s, ix * 2000 + track % 7 * 100 + 1500 AS e FROM cues)"


def _said(spark, d):
    c = A.cues(spark, d)
    t = F.rtrim(F.concat(F.lit("T"), F.col("ix").cast("string"), F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")))
    s = F.col("ix") * 2000 + F.col("track") % 7 * 100
    return c.select("track", "ix", t.alias("t"), s.alias("s"), (s + 1500).alias("e"))


def _file(rows, part, head="", foot=""):
    """(track, text): the parts of a track's cues behind each other."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", part.alias("p")))), lambda x: x["p"]), "")
    return rows.groupBy("track").agg(F.concat(F.lit(head) if isinstance(head, str) else head, body, F.lit(foot)).alias("text"))


@query(f"""WITH {_SAID}, f AS (SELECT *, ix * 50 + 5 AS a, ix * 50 + 35 + track % 3 AS b, CASE WHEN track % 2 = 0 THEN 25.0::DOUBLE ELSE 24.0::DOUBLE END AS rate FROM said)
    SELECT track, ix, round(a * 1000.0::DOUBLE / rate)::BIGINT AS start_ms, round(b * 1000.0::DOUBLE / rate)::BIGINT AS end_ms, CASE WHEN ix % 3 = 0 THEN '<i>' || t || chr(10) || 'a &amp; &lt;b&gt;</i>' ELSE t END AS text FROM f""", "cues")
def microdvd_cues(spark, d):
    """J07, MicroDVD: half of the files declare their rate."""
    n = lambda c: c.cast("string")
    a = F.col("ix") * 50 + 5
    body = F.when(F.col("ix") % 3 == 0, F.concat(F.lit("{y:i}"), "t", F.lit("|a & <b>"))).otherwise(F.col("t"))
    line = F.concat(F.lit("{"), n(a), F.lit("}{"), n(a + 30 + F.col("track") % 3), F.lit("}"), body, F.lit("\n"))
    f = _file(_said(spark, d), line)
    even = F.col("track") % 2 == 0
    return O.microdvd(f.select("track", F.when(even, F.concat(F.lit("{1}{1}25\n"), "text")).otherwise(F.col("text")).alias("text"), F.when(~even, 24.0).alias("fps")))


@query(f"WITH {_SAID} SELECT track, ix, s AS start_ms, e AS end_ms, t || chr(10) || 'more, of it' AS text FROM said", "cues")
def subviewer_cues(spark, d):
    """J07, SubViewer."""
    clock = lambda c: F.substring(timing.clock(F.col(c)), 1, 11)
    return O.subviewer(_file(_said(spark, d), F.concat(clock("s"), F.lit(","), clock("e"), F.lit("\n"), "t", F.lit("[br]more, of it\n\n")), "[INFORMATION]\n\n"))


@query(f"WITH {_SAID} SELECT track, ix, s + track % 5 * 1000 AS start_ms, e + track % 5 * 1000 AS end_ms, t || chr(10) || 'x & y' AS text FROM said", "cues")
def ttml_cues(spark, d):
    """Times of paragraphs inside those of their parents."""
    p = F.concat(F.lit('<p begin="'), F.col("s").cast("string"), F.lit('ms" end="'), F.col("e").cast("string"), F.lit('ms">'), "t", F.lit("<br/>x &amp; y</p>"))
    head = F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml"><body begin="'), F.first(F.col("track") % 5).cast("string"), F.lit('s"><div end="200000s">'))
    return O.ttml(_file(_said(spark, d), p, head, "</div></body></tt>"))


@query(f"WITH {_SAID} SELECT track, 'EN' AS class, ix, s AS start_ms, e AS end_ms, t || chr(10) || 'b' AS text FROM said UNION ALL SELECT track, 'JP', ix, s, e, '<i>' || t || '</i> red' FROM said", "cues")
def sami_cues(spark, d):
    """What two classes show from one sync point to the next."""
    n = lambda c: F.col(c).cast("string")
    part = F.concat(F.lit("<SYNC Start="), n("s"), F.lit("><P Class=EN>"), "t", F.lit('<br>b<P Class="JP"><i>'), "t", F.lit('</i> <font color="red">red</font>\n<SYNC Start="'), n("e"), F.lit('"><P Class=EN>&nbsp;<P Class=JP>&nbsp;\n'))
    f = _file(_said(spark, d), part, "<SAMI><HEAD><STYLE>.EN {lang: en}</STYLE></HEAD><BODY>\n", "</BODY></SAMI>")
    return O.sami(f.withColumn("duration_ms", F.lit(10**9).cast("bigint")))


_ROLES = "roles AS (SELECT conv_id AS track, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS ix, coalesce(role, '') AS role FROM conversations)"
_CLOCK = "printf('%d:%02d:%02d.%02d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000 // 10)"


@query(f"WITH {_SAID} SELECT track, ix, CASE WHEN ix % 5 < 4 THEN 'Dialogue: ' || track % 4 || ',' || {_CLOCK.format('s')} || ',' || {_CLOCK.format('(s + greatest(track % 2 * 1500, 10))')} || ',Default,N,0,0,0,,' || t || ', more' || chr(10) END AS line FROM said", "cues")
def ass_lines(spark, d):
    """Events of nine fields as dialogue lines; one in five has no number in front."""
    event = F.concat(F.when(F.col("ix") % 5 < 4, F.col("ix").cast("string")).otherwise("x"), F.lit(","), (F.col("track") % 4).cast("string"), F.lit(",Default,N,0,0,0,,"), "t", F.lit(", more"))
    return _said(spark, d).select("track", "ix", O.ass_dialogue(event, F.col("s"), F.col("track") % 2 * 1500).alias("line"))


@query("""WITH x AS (SELECT o_orderkey AS o, ['start', 'left', 'center', 'right', 'end', ''][o_orderkey % 6 + 1] AS a, o_custkey % 101 AS line FROM orders)
    SELECT o, 1 + CASE WHEN o % 7 = 0 THEN 0 WHEN line <= 20 THEN 6 WHEN line < 80 THEN 3 ELSE 0 END + CASE WHEN a IN ('start', 'left') THEN 0 WHEN a IN ('right', 'end') THEN 2 ELSE 1 END AS place FROM x""")
def ass_places(spark, d):
    """Number-pad places of WebVTT settings."""
    o = F.col("o_orderkey")
    align = F.element_at(F.array(*[F.lit(x) for x in ("align:start", "align:left", "align:center", "align:right", "align:end", "size:50%")]), (o % 6 + 1).cast("int"))
    settings = F.concat_ws(" ", F.when(o % 7 != 0, F.concat(F.lit("line:"), (F.col("o_custkey") % 101).cast("string"), F.lit("%"))), align)
    return A.table(spark, d, "orders").select(o.alias("o"), O.ass_alignment(settings).alias("place"))


@query(f"WITH {_SAID} SELECT track, ix, CASE ix % 5 WHEN 0 THEN t WHEN 1 THEN t || chr(10) || 'you' WHEN 2 THEN t || ', no' WHEN 3 THEN t END AS text FROM said", "cues")
def payload_texts(spark, d):
    """Text of native samples by their codec; a length that leads beyond its sample gives none."""
    r = F.col("ix") % 5
    hexed = F.hex(F.encode("t", "UTF-8"))
    long = F.when(r == 4, F.octet_length("t") + 99).otherwise(F.octet_length("t"))
    timed = F.concat(M.num(long, 2), hexed, F.lit("0000000C7374796C00000000"))
    raw = F.when(r == 1, F.concat(F.lit("1,0,Default,,0,0,0,,{\\i1}"), "t", F.lit("\\Nyou"))).when(r == 2, F.concat(F.lit("Dialogue: 0,0:00:01.00,0:00:02.00,D,,0,0,0,,"), "t", F.lit(", no"))).otherwise(F.concat(F.lit(" <b>"), "t", F.lit("</b> {x{y}}")))
    payload = F.when(r.isin(0, 4), F.unhex(timed)).otherwise(F.encode(raw, "UTF-8"))
    codec = F.element_at(F.array(*[F.lit(x) for x in ("mov_text", "ass", "ssa", "subrip", "tx3g")]), (r + 1).cast("int"))
    return _said(spark, d).select("track", "ix", O.payload_text(codec, payload).alias("text"))


@query(f"""WITH {_SAID}, x AS (SELECT track, ix, (track + ix) % 8 AS k, t FROM said)
    SELECT track || '-' || ix || '.' || ['srt', 'srt', 'vtt', 'srt', 'vtt', 'ttml', 'scc', 'srt'][k + 1] AS path, CASE WHEN k IN (0, 1, 3) THEN 'é ' || t WHEN k = 5 THEN '<?xml version="1.0" encoding="iso-8859-1"?><tt>é ' || t || '</tt>' END AS text,
           CASE k WHEN 2 THEN 'cannot be decoded' WHEN 4 THEN 'needs UTF-8' WHEN 6 THEN 'needs ASCII' WHEN 7 THEN 'null characters' END AS error FROM x""", "cues")
def decoded_sidecars(spark, d):
    """Texts in several encodings, and those that cannot be read."""
    k = (F.col("track") + F.col("ix")) % 8
    said = F.concat(F.lit("é "), "t")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="iso-8859-1"?><tt>'), said, F.lit("</tt>"))
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode(said, "UTF-16LE"))
    content = F.when(k.isin(0, 6), F.encode(said, "UTF-8")).when(k.isin(1, 2), F.encode(said, "ISO-8859-1")).when(k.isin(3, 4), wide).when(k == 5, F.encode(xml, "ISO-8859-1")).otherwise(F.concat(F.encode("t", "UTF-8"), F.unhex(F.lit("00"))))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("srt", "srt", "vtt", "srt", "vtt", "ttml", "scc", "srt")]), (k + 1).cast("int"))
    return S.decoded(_said(spark, d).select(F.concat(F.col("track").cast("string"), F.lit("-"), F.col("ix").cast("string"), F.lit("."), kind).alias("path"), content.alias("content")))


_FRAME = "((({0}) * 1001 + 15) // 30)"


@query(f"""WITH {_SAID}, w AS (SELECT track, ix, rpad(substr(regexp_replace(t, ' ', '', 'g'), 1, 20), 20, 'z') AS t, (ix * 4 + 1) * 30 AS f FROM said)
    SELECT track, 'CC1' AS channel, ix, {_FRAME.format("f + 14")}::BIGINT AS start_ms, {_FRAME.format("f + 60")}::BIGINT AS end_ms, '<i>' || t || 'é</i>' AS text FROM w""", "cues")
def caption_cues(spark, d):
    """Line-21 captions that pop on and are cleared a second and a half later; control words are sent twice."""
    odd = lambda c: M.num(F.when(F.bit_count(c) % 2 == 0, c + 128).otherwise(c), 1)
    t = F.rpad(F.substring(F.regexp_replace("t", " ", ""), 1, 20), 20, "z")
    at = lambda k: F.ascii(F.substring(t, k, 1))
    pairs = [F.concat(odd(at(k)), odd(at(k + 1))) for k in range(1, 20, 2)]
    code = lambda a, b: F.lit(f"{a | (128 if a.bit_count() % 2 == 0 else 0):02X}{b | (128 if b.bit_count() % 2 == 0 else 0):02X}")
    label = lambda f: F.format_string("%02d:%02d:%02d:%02d", *[timing._int_div(f, 108_000), timing._int_div(f, 1800) % 60, timing._int_div(f, 30) % 60, f % 30])
    f = (F.col("ix") * 4 + 1) * 30
    shown = F.concat_ws(" ", code(0x14, 0x20), code(0x14, 0x20), code(0x11, 0x4E), *pairs, code(0x5C, 0), code(0x14, 0x2F), code(0x14, 0x2F))
    part = F.concat(label(f), F.lit("\t"), shown, F.lit("\n\n"), label(f + 60), F.lit("\t"), code(0x14, 0x2C), F.lit(" "), code(0x14, 0x2C), F.lit("\n\n"))
    return C.captions(_file(_said(spark, d), part, "Scenarist_SCC V1.0\n\n").withColumn("duration_ms", F.lit(None).cast("bigint")))


_UNITS = f"""WITH {M.ITEMS}, u AS (SELECT o, ix, size, 96 + step % 32 AS head, step % 32 AS type, 4 + coalesce(sum(size + 4) OVER (PARTITION BY o ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM items WHERE o % 6 <> 5)"""


def _units(spark, d):
    """(o, data): length-prefixed units of a type each; the last of every sixth order is a byte too long."""
    unit = lambda r: F.concat(M.num(r["size"] + F.when((F.col("o") % 6 == 5) & (r["ix"] == F.col("n") - 1), 1).otherwise(0), 4), M.num(96 + r["step"] % 32, 1), F.repeat(F.lit("AB"), (r["size"] - 1).cast("int")))
    return M._by_order(spark, d).select("o", F.unhex(M.each("i", unit)).alias("data"))


@query(f"""{_UNITS} SELECT o, ix::INT AS ix, "offset"::INT AS "offset", size AS length, type::INT AS type FROM u""")
def nal_units(spark, d):
    """K08."""
    u = _units(spark, d).select("o", F.posexplode(B.nal_units(F.col("data"))).alias("ix", "u"))
    return u.select("o", "ix", F.col("u.offset").alias("offset"), F.col("u.length").alias("length"), F.col("u.type").alias("type"))


@query(f"""{_UNITS} SELECT o, string_agg('00000001' || printf('%02X', head) || repeat('AB', (size - 1)::INT), '' ORDER BY ix) AS framed FROM u GROUP BY o UNION ALL SELECT DISTINCT o, NULL FROM items WHERE o % 6 = 5""")
def start_codes(spark, d):
    """K09."""
    return _units(spark, d).select("o", F.hex(B.annex_b(F.col("data"))).alias("framed"))


@query(f"""WITH {M.ITEMS} SELECT o, ix, CASE WHEN step % 6 BETWEEN 1 AND 4 AND step % 15 <= 12 AND (o + ix) % 9 BETWEEN 1 AND 7 AND size * (o % 2 * 300 + 1) + 7 <= 8191 THEN
    printf('%014X', (65521::HUGEINT * 1099511627776 + (step % 6 - 1) * 274877906944 + (step % 15) * 17179869184 + ((o + ix) % 9 // 4) * 4294967296 + ((o + ix) % 9 % 4) * 1073741824 + (size * (o % 2 * 300 + 1) + 7) * 8192 + 8188)::BIGINT) END AS header FROM items""")
def adts_headers(spark, d):
    """Headers of AAC frames, where all fields fit."""
    i = M.items(spark, d)
    frame = F.unhex(F.repeat(F.lit("00"), (F.col("size") * (F.col("o") % 2 * 300 + 1)).cast("int")))
    return i.select("o", "ix", B.adts_header(frame, F.col("step") % 6, F.col("step") % 15, (F.col("o") + F.col("ix")) % 9).alias("header"))


@query(f"""WITH {M.ITEMS} SELECT o, ix, (step % 30 + 1)::INT AS object_type, (o % 13)::INT AS rate_index, [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][o % 13 + 1]::BIGINT AS sample_rate, (ix % 8)::INT AS channels,
    [48000, 44100, 32000][o % 3 + 1] AS ac3_rate, ([2, 1, 2, 3, 3, 4, 4, 5][step % 8 + 1] + ix % 2)::INT AS ac3_channels, [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640][size % 19 + 1] AS ac3_kbps FROM items""")
def audio_configurations(spark, d):
    """Configurations of AAC and AC-3."""
    i = M.items(spark, d)
    aac = M.num((F.col("step") % 30 + 1) * 2048 + F.col("o") % 13 * 128 + F.col("ix") % 8 * 8, 2)
    ac3 = M.num(F.col("o") % 3 * 2**22 + 8 * 2**17 + F.col("step") % 8 * 2**11 + F.col("ix") % 2 * 2**10 + F.col("size") % 19 * 2**5, 3)
    r = i.select("o", "ix", B.aac_config(F.unhex(aac)).alias("a"), B.ac3_config(F.unhex(ac3)).alias("b"))
    return r.select("o", "ix", "a.*", F.col("b.sample_rate").alias("ac3_rate"), F.col("b.channels").alias("ac3_channels"), F.col("b.kbps").alias("ac3_kbps"))


@query("SELECT o_orderkey AS o, (o_orderkey * 65536 + o_custkey) // 65536 AS whole, abs(o_orderkey - o_custkey) AS delta FROM orders")
def fixed_points(spark, d):
    """I13 and I14."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return A.table(spark, d, "orders").select(o.alias("o"), timing.fixed_point(o * 65536 + c).alias("whole"), timing.sample_delta(o, c).alias("delta"))


@query("""WITH p AS (SELECT o_orderkey AS source, o_orderkey % 256 AS r, o_custkey % 256 AS g, (o_orderkey + o_custkey) % 256 AS b, 2 + o_orderkey % 9 AS w, 1 + o_custkey % 5 AS h FROM orders),
    l AS (SELECT *, (r * 54 + g * 183 + b * 19) // 256 AS luma FROM p)
    SELECT source, w AS width, h AS height, repeat(printf('%02X', luma), (w * h)::INT) AS luma, CASE WHEN luma > 100 AND greatest(r, g, b) - least(r, g, b) > 48 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS color_fraction FROM l WHERE source % 10 <> 9""")
def reduced_pictures(spark, d):
    """Pictures of one colour each; one in ten lacks a byte."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    w, h = 2 + o % 9, 1 + c % 5
    raw = F.repeat(F.concat(M.num((o + c) % 256, 1), M.num(c % 256, 1), M.num(o % 256, 1), F.lit("00")), (w * h).cast("int"))
    rows = A.table(spark, d, "orders").select(o.alias("source"), F.lit(0).cast("bigint").alias("time_ms"), w.alias("width"), h.alias("height"), F.unhex(F.when(o % 10 == 9, F.substring(raw, F.lit(3), F.length(raw))).otherwise(raw)).alias("bgra"))
    return P.reduced(rows).select("source", "width", "height", F.hex("luma").alias("luma"), "color_fraction")


@query("""WITH p AS (SELECT s_suppkey AS source, s_suppkey % 9 AS lines, s_suppkey % 4 = 0 AS colored FROM supplier)
    SELECT source, lines >= 3 AND NOT colored AS text_like, round(1 - lines * 240 / 57600.0::DOUBLE, 9) AS dark_fraction, round(lines * 240 / 57600.0::DOUBLE, 9) AS bright_fraction, CASE WHEN colored THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS color_fraction FROM p""")
def text_like_pictures(spark, d):
    """Pages of no to eight lines of twenty letters."""
    blank, letters = "0A" * 320, "0A" * 10 + ("C8" + "0A" * 13) * 20 + "0A" * 30
    feet = "0A" * 10 + ("C8" * 5 + "0A" * 9) * 20 + "0A" * 30
    k = F.col("s_suppkey") % 9
    page = F.concat(F.lit(blank * 10), F.repeat(F.lit(letters * 7 + feet + blank * 12), k.cast("int")), F.repeat(F.lit(blank * 20), (8 - k).cast("int")), F.lit(blank * 10))
    rows = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.lit(0).cast("bigint").alias("time_ms"), F.lit(320).cast("bigint").alias("width"), F.lit(180).cast("bigint").alias("height"), F.unhex(page).alias("luma"), F.when(F.col("s_suppkey") % 4 == 0, 0.5).otherwise(0.0).alias("color_fraction"))
    return P.observed(rows).select("source", "text_like", F.round("dark_fraction", 9).alias("dark_fraction"), F.round("bright_fraction", 9).alias("bright_fraction"), "color_fraction")


#: Customers as sources with a run of evidence from sample 1 to sample 2, neighbours, and a probe each second around both ends.
_CREDITS = """c AS (SELECT c_custkey AS source, 40000 + c_custkey % 11 * 1000 AS s, 70000 + c_custkey % 13 * 2000 AS e, 200000 AS duration_ms, 40000 + c_custkey % 11 * 1000 - (3 + c_custkey % 15) * 1000 AS before, 70000 + c_custkey % 13 * 2000 + (2 + c_custkey % 16) * 1000 AS after FROM customer),
    p AS (SELECT source, t, (source * 7 + t // 1000) % 5 > 0 AS yes FROM (SELECT source, unnest(range(20000, 120001, 1000)) AS t FROM c)),
    r AS (SELECT *, greatest(before, s - 10000) AS f, least(after, e + 10000) AS u FROM c),
    h AS (SELECT source, min(t) AS t FROM r JOIN p USING (source) WHERE t BETWEEN f AND s AND yes GROUP BY source),
    n AS (SELECT source, min(t) AS stop FROM r JOIN p USING (source) WHERE t BETWEEN e AND u AND NOT yes GROUP BY source),
    l AS (SELECT source, max(t) AS t FROM r JOIN p USING (source) LEFT JOIN n USING (source) WHERE t BETWEEN e AND u AND yes AND t < coalesce(stop, 10000000) GROUP BY source)"""


@query(f"WITH {_CREDITS} SELECT source, 1::BIGINT AS first_ix, 2::BIGINT AS last_ix, coalesce(h.t, s)::BIGINT AS start_ms, coalesce(l.t, e)::BIGINT AS end_ms, 0.93::DOUBLE AS confidence FROM r LEFT JOIN h USING (source) LEFT JOIN l USING (source) WHERE coalesce(l.t, e) - coalesce(h.t, s) >= 20000")
def refined_credits(spark, d):
    """boundaries moved by probes."""
    k = F.col("c_custkey")
    s, e = 40_000 + k % 11 * 1000, 70_000 + k % 13 * 2000
    c = A.table(spark, d, "customer").select(k.alias("source"), s.alias("s"), e.alias("e"), F.array(s - (3 + k % 15) * 1000, s, e, e + (2 + k % 16) * 1000).alias("times"))
    samples = c.select("source", F.posexplode("times").alias("ix", "time_ms")).withColumn("ix", F.col("ix").cast("bigint"))
    runs = c.select("source", F.lit(1).cast("bigint").alias("first_ix"), F.lit(2).cast("bigint").alias("last_ix"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    probes = c.select("source", F.explode(F.sequence(F.lit(20_000), F.lit(120_000), F.lit(1000))).alias("t")).select("source", F.col("t").cast("bigint").alias("time_ms"), ((F.col("source") * 7 + F.col("t") / 1000) % 5 > 0).alias("text_like"))
    return R.refined(runs, samples, probes, c.select("source", F.lit(200_000).cast("bigint").alias("duration_ms")))


def _arriving(spark, d, reordered=False):
    """Packets with a mark on each track's last, in three lots by place."""
    last = F.max("ix").over(K.W.partitionBy("track"))
    return A.packets(spark, d, reordered).withColumn("last", F.col("ix") == last).withColumn("lot", F.least(F.floor(F.col("ix") * 3 / (last + 1)), F.lit(2)).cast("int"))


def streamed_chunks(spark, d):
    """Chunks out of a stream that arrives in three lots."""
    return planner.replayed(_arriving(spark, d), "lot", lambda s: planner.stream_chunks(s, A.DAY))


REGISTRY.queries["streamed_chunks"], REGISTRY.sql["streamed_chunks"] = streamed_chunks, chunk_queries.REGISTRY.sql["chunk_plan"]


@query("""WITH l AS (SELECT *, lead(pts) OVER (PARTITION BY track ORDER BY ix) - pts AS d FROM packets), a AS (SELECT *, CASE WHEN d >= 0 THEN d WHEN d < 0 THEN 0 END AS ahead FROM l)
    SELECT track, ix, pts, coalesce(ahead, lag(ahead) OVER (PARTITION BY track ORDER BY ix), 0) AS duration FROM a""", "reordered")
def streamed_durations(spark, d):
    """Durations out of a stream that arrives in three lots."""
    return planner.replayed(_arriving(spark, d, reordered=True), "lot", planner.stream_durations)


@query("SELECT source, time_ms, bool_or(text_like) AS text_like FROM observations GROUP BY source, time_ms", "observations")
def resumed_scan(spark, d):
    """Every sample once, out of a stream in which each lot brings what came before it again."""
    o = A.observations(spark, d).groupBy("source", "time_ms").agg(F.bool_or("text_like").alias("text_like"))
    by = K.W.partitionBy("source").orderBy("time_ms")
    o = o.withColumn("k", F.ntile(3).over(by) - 1)
    lots = o.withColumn("lot", F.explode(F.sequence(F.col("k"), F.lit(2)))).drop("k")
    return planner.replayed(lots, "lot", planner.stream_new)


@query(f"""WITH {M.ITEMS} SELECT o, ix, (step % 3)::INT AS frame_type, (ix % 8)::INT AS substream, (size * 20)::INT AS frame_bytes, CASE WHEN o % 4 = 3 THEN [24000, 22050, 16000][shift + 1] ELSE [48000, 44100, 32000][o % 4 + 1] END AS sample_rate,
    CASE WHEN o % 4 = 3 THEN 6 ELSE [1, 2, 3, 6][shift + 1] END AS blocks, ([2, 1, 2, 3, 3, 4, 4, 5][step % 8 + 1] + ix % 2)::INT AS channels FROM items""")
def eac3_headers(spark, d):
    """K11, E-AC-3."""
    i = M.items(spark, d)
    word = F.col("step") % 3 * 2**14 + F.col("ix") % 8 * 2**11 + F.col("size") * 10 - 1
    second = F.col("o") % 4 * 64 + F.col("shift") * 16 + F.col("step") % 8 * 2 + F.col("ix") % 2
    frame = F.unhex(F.concat(F.lit("0B77"), M.num(word, 2), M.num(second, 1)))
    return i.select("o", "ix", B.eac3_header(frame).alias("h")).select("o", "ix", "h.*")


@query(f"""WITH {M.ITEMS} SELECT o, ix, (size + 1)::INT AS blocks, (size * 100 + 1)::INT AS frame_bytes, (step % 16)::INT AS arrangement, [NULL, 8000, 16000, 32000, NULL, NULL, 11025, 22050, 44100, NULL, NULL, 12000, 24000, 48000, NULL, NULL][o % 16 + 1] AS sample_rate,
    shift > 0 AS lfe, ([1, 2, 2, 2, 2, 3, 3, 4, 4, 5, 6, 6, 6, 7, 8, 8][step % 16 + 1] + (shift > 0)::INT)::INT AS channels FROM items""")
def dts_headers(spark, d):
    """K11, DTS."""
    i = M.items(spark, d)
    # 7 bits of head, 7 of blocks, 14 of bytes, 6 of arrangement, 4 of rate, 15 others, 2 of the bass channel and 9 to fill
    low = ((((F.lit(0) * 128 + F.col("size")) * 2**14 + F.col("size") * 100) * 64 + F.col("step") % 16) * 16 + F.col("o") % 16).cast("bigint")
    frame = F.unhex(F.concat(F.lit("7FFE8001"), M.num(low * 4, 5), M.num(F.col("shift") * 2**9, 3)))
    return i.select("o", "ix", B.dts_header(frame).alias("h")).select("o", "ix", "h.*")


@query(f"""WITH {_SAID} SELECT track, ix, CASE track % 4 WHEN 0 THEN t WHEN 1 THEN '<b>' || t[1:1] || '</b>' || t[2:] WHEN 2 THEN t[1:1] || '<i><u>' || t[2:2] || '</u></i>' || CASE WHEN length(t) > 2 THEN t[3:] ELSE '' END END AS text FROM said""", "cues")
def styled_texts(spark, d):
    """Runs of faces in timed text; a quarter of the tracks have runs that overlap."""
    k = F.col("track") % 4
    run = lambda a, b, face: F.concat(M.num(a, 2), M.num(b, 2), F.lit("0001"), M.num(face, 1), F.lit("12FFFFFFFF"))
    runs = F.when(k == 1, run(0, 1, 1)).when(k == 2, run(1, 2, 6)).otherwise(F.concat(run(0, 2, 1), run(1, 2, 2)))
    count = F.when(k == 3, 2).otherwise(1)
    box = F.when(k == 0, F.lit("")).otherwise(F.concat(M.num(F.length(runs) / 2 + 10, 4), M.text("styl"), M.num(count, 2), runs))
    payload = F.unhex(F.concat(M.num(F.octet_length("t"), 2), M.text(F.col("t")), box))
    return _said(spark, d).select("track", "ix", O.styled_text(payload).alias("text"))


@query(f"WITH {_SAID} SELECT track, ix, k::BIGINT AS k, s AS start_ms, e AS end_ms, CASE WHEN k = 0 THEN ix::VARCHAR END AS id, CASE WHEN track % 2 = 0 THEN 'line:1' END AS settings, t || CASE WHEN k = 1 THEN ' b' ELSE '' END AS text FROM said, range(0, 2) g(k) WHERE ix % 4 < 2 OR (ix % 4 = 2 AND k = 0)", "cues")
def webvtt_sample_cues(spark, d):
    """MP4 samples of WebVTT with two cues, one cue, or a box too long."""
    raw = lambda name, body: M.box(name, M.text(body))
    settings = F.when(F.col("track") % 2 == 0, raw("sttg", "line:1")).otherwise("")
    one = M.box("vttc", raw("iden", F.col("ix").cast("string")), settings, raw("payl", F.col("t")))
    two = M.box("vttc", settings, raw("payl", F.concat("t", F.lit(" b"))))
    body = F.when(F.col("ix") % 4 < 2, F.concat(one, two)).when(F.col("ix") % 4 == 2, F.concat(one, M.box("vtte"), M.box("vttc", settings))).otherwise(F.concat(one, F.lit("000000FF76747465")))
    rows = _said(spark, d).select("track", "ix", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), F.unhex(body).alias("payload"))
    return O.webvtt_samples(rows)


@query("SELECT o_custkey AS track, list_sort(list_distinct(array_agg(printf('%06x', o_orderkey % 16777216)))) AS colors FROM orders WHERE o_orderkey % 5 > 0 GROUP BY o_custkey")
def color_classes(spark, d):
    """A cue in five names no colour."""
    from ..operators import cues as U

    o = F.col("o_orderkey")
    tag = F.when(o % 5 > 0, F.concat(F.lit("<c.ttmlc"), F.lower(F.lpad(F.hex(o % 16777216), 6, "0")), F.lit(">x</c> y"))).otherwise("<i>x</i>")
    return U.color_classes(A.table(spark, d, "orders").select(F.col("o_custkey").alias("track"), tag.alias("text")))


@query("SELECT s_suppkey AS track, c AS class, CASE WHEN c = 'ENCC' THEN 'en-US' ELSE 'ja' END AS language, CASE WHEN c = 'ENCC' THEN s_name END AS name FROM supplier, (VALUES ('ENCC'), ('JPCC')) v(c)")
def sami_styles(spark, d):
    """Languages and names of classes."""
    sheet = F.concat(F.lit('<SAMI><HEAD><STYLE TYPE="text/css"><!--\nP {color: white}\n.ENCC { Name: "'), "s_name", F.lit('"; lang: en-US; SAMIType: CC; }\n.JPCC {lang:ja}\n--></STYLE></HEAD><BODY></BODY></SAMI>'))
    return O.sami_classes(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("track"), sheet.alias("text")))


@query("""WITH f AS (SELECT l_orderkey AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) - 1 AS ix FROM lineitem),
    g AS (SELECT source, ix, ix * 150 AS time_ms, (ix + source) % 3 = 0 AS keyframe FROM f), r AS (SELECT DISTINCT source, k * 190 + 20 AS time_ms FROM g, range(0, 4) x(k)),
    b AS (SELECT r.source, r.time_ms, coalesce(max(g.ix), 0) AS first_ix FROM r LEFT JOIN g ON g.source = r.source AND g.keyframe AND g.time_ms <= r.time_ms GROUP BY ALL),
    n AS (SELECT b.source, b.time_ms, g.ix, g.time_ms AS frame_ms, row_number() OVER (PARTITION BY b.source, b.time_ms ORDER BY abs(g.time_ms - b.time_ms), g.ix) AS k FROM b JOIN g ON g.source = b.source AND g.ix >= first_ix AND abs(g.time_ms - b.time_ms) <= 200)
    SELECT source, time_ms, ix, frame_ms FROM n WHERE k = 1""")
def decoded_frames(spark, d):
    """The nearest frame behind the last keyframe at or before a time."""
    i = M.items(spark, d).select(F.col("o").alias("source"), "ix", (F.col("ix") * 150).alias("time_ms"), ((F.col("ix") + F.col("o")) % 3 == 0).alias("keyframe"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint")))
    r = i.select("source").distinct().withColumn("k", k).select("source", (F.col("k") * 190 + 20).alias("time_ms"))
    return R.decoded_frame(i, r)


@query("""WITH p AS (SELECT track AS source, ix, pts, 400 + ix % 7 AS samples FROM (SELECT track, ix, ix * 50 + CASE WHEN track % 3 = 0 AND ix > 9 THEN 300 ELSE 0 END AS pts FROM packets)),
    e AS (SELECT *, first(pts) OVER w + coalesce(sum(samples) OVER (PARTITION BY source ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1000 // 8000 AS expected FROM p WINDOW w AS (PARTITION BY source ORDER BY ix))
    SELECT source, count(*) AS packets, min(ix) FILTER (abs(expected - pts) > 150) AS broken FROM e GROUP BY source""", "packets")
def print_gaps(spark, d):
    """Packets of samples on one clock, with a gap in a third of the sources."""
    p = A.packets(spark, d)
    pts = F.col("ix") * 50 + F.when((F.col("track") % 3 == 0) & (F.col("ix") > 9), 300).otherwise(0)
    return R.print_gaps(p.select(F.col("track").alias("source"), "ix", pts.alias("pts"), (F.lit(400) + F.col("ix") % 7).alias("samples"), F.lit(8000).alias("rate")))


_SIDES = """w AS (SELECT c_custkey AS source, k AS "window", 300000 + c_custkey % 5 * 1000 + k * 400000 AS end_ms FROM customer, range(0, 2) g(k)),
    f AS (SELECT w.source, w."window", side, (w.source + side + 1) % (SELECT count(*) FROM customer) AS peer, pw AS peer_window, w.end_ms - 240000 + (w.source * 7 + pw) % 9 * 20000 AS start_ms, w.end_ms - 240000 + (w.source * 7 + pw) % 9 * 20000 + 100000 + side * 5000 AS end_ms, 0.9::DOUBLE + (w.source % 10) / 100.0::DOUBLE AS quality, 0::BIGINT AS ix FROM w, range(0, 2) s(side), range(0, 2) p(pw)),
    good AS (SELECT f.* FROM f JOIN w p ON p.source = f.peer AND p."window" = f.peer_window JOIN w o ON o.source = f.source AND o."window" = f."window"
        WHERE (f.peer_window = 0 OR (f.start_ms >= greatest(p.end_ms - 240000, 0) AND f.end_ms >= greatest(p.end_ms - 90000, 0) AND f.end_ms <= p.end_ms)) AND (f."window" = 0 OR (f.start_ms >= greatest(o.end_ms - 240000, 0) AND f.end_ms >= greatest(o.end_ms - 90000, 0) AND f.end_ms <= o.end_ms))),
    pairs AS (SELECT a.source, a."window", greatest(a.start_ms, b.start_ms) AS start_ms, least(a.end_ms, b.end_ms) AS end_ms, greatest(a.end_ms - a.start_ms, b.end_ms - b.start_ms) AS long, least(a.quality, b.quality) AS quality FROM good a JOIN good b ON a.source = b.source AND a."window" = b."window" AND a.side = 0 AND b.side = 1 WHERE b.start_ms < a.end_ms AND b.end_ms > a.start_ms),
    agreed AS (SELECT source, "window", start_ms, end_ms, max(quality) AS quality FROM pairs WHERE end_ms - start_ms >= 15000 AND (end_ms - start_ms) / long::DOUBLE >= 0.8 AND quality >= 0.9 GROUP BY ALL)"""


@query(f"""WITH {_SIDES} SELECT source, "window", start_ms, end_ms, round(quality, 9) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY source, "window" ORDER BY end_ms - start_ms DESC, quality DESC, start_ms, end_ms) AS k FROM agreed) WHERE k = 1""")
def peer_windows(spark, d):
    """Windows of two peers, and what both repeat."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("source"))
    n = c.count()
    each = lambda name: F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias(name)
    w = c.select("source", each("window")).withColumn("end_ms", F.lit(300_000) + F.col("source") % 5 * 1000 + F.col("window") * 400_000)
    f = w.select("*", each("side")).select("*", each("peer_window"))
    start = F.col("end_ms") - 240_000 + (F.col("source") * 7 + F.col("peer_window")) % 9 * 20_000
    f = f.select("source", "window", "side", ((F.col("source") + F.col("side") + 1) % n).alias("peer"), "peer_window", start.alias("start_ms"), (start + 100_000 + F.col("side") * 5000).alias("end_ms"), (F.lit(0.9) + F.col("source") % 10 / F.lit(100.0)).alias("quality"), F.lit(0).cast("bigint").alias("ix"))
    return R.peer_windows(f, w).withColumn("quality", F.round("quality", 9))

"""Checks of the Column functions, over columns made from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.adapters import events, raw_frames, table
from wlanlake.catalog.common import BSS, EVENTS, SRC, stamp, stamp_sql
from wlanlake.functions import cells, labels, payload, radio, registry, timeparts, verdicts
from wlanlake.operators.filters import attacks_only

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None, source=events):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_events(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([EVENTS, *ctes]) + " " + body


# ---- cells ---------------------------------------------------------------------------

# One cell shape per remainder: signed series, separators, flags, hex, commas, blanks, ...
CELL = """case event_id % 12 when 0 then concat('0-8-', k, '-12') when 1 then concat('-', 30 + k, '-32-29')
  when 2 then '1-0-0' when 3 then concat(' ', k, '.5 ') when 4 then format_string('0x%x', k)
  when 5 then concat('a,', k, ', 3') when 6 then '?' when 7 then 'None' when 8 then ''
  when 9 then concat('x-', k, '-y-4') when 10 then concat(k, 'e2') else null end"""
NUMBERS_SQL = """CASE event_id % 12 WHEN 0 THEN [0, 8, k, 12] WHEN 1 THEN [-30 - k, -32, -29] WHEN 2 THEN [1, 0, 0]
  WHEN 3 THEN [k + 0.5] WHEN 4 THEN [k] WHEN 5 THEN [k, 3] WHEN 9 THEN [k, 4] WHEN 10 THEN [k * 100] ELSE [] END"""


@query("parse_multi", with_events(f"SELECT event_id, CAST({NUMBERS_SQL} AS DOUBLE[]) AS numbers FROM e"))
def _multi(df):
    cell = df.selectExpr("event_id", f"{CELL} as cell")
    return cell.selectExpr("event_id", f"{cells.parse_multi('cell')} as numbers")


@query(
    "parse_first_sum",
    with_events(
        f"SELECT event_id, n[1] AS first, CASE WHEN len(n) > 0 THEN list_sum(n) END AS total, "
        f"CAST(trunc(n[1]) AS BIGINT) AS whole FROM (SELECT event_id, CAST({NUMBERS_SQL} AS DOUBLE[]) AS n FROM e) t"
    ),
)
def _first_sum(df):
    cell = df.selectExpr("event_id", f"{CELL} as cell")
    return cell.selectExpr(
        "event_id",
        f"{cells.first_number('cell')} as first",
        f"{cells.sum_number('cell')} as total",
        f"{cells.first_int('cell')} as whole",
    )


@query(
    "present_flag",
    with_events("SELECT event_id, CASE WHEN event_id % 12 IN (6, 8, 11) THEN 0 ELSE 1 END AS present FROM e"),
)
def _present(df):
    cell = df.selectExpr("event_id", f"{CELL} as cell")
    return cell.selectExpr("event_id", f"{cells.present('cell')} as present")


# Spellings tried, and what they mean.
SPELLINGS = {
    "Normal": "Normal", " Deauth ": "Deauth", "SDDP": "SSDP", "Kr00K": "Kr00k", "re)assoc": "(Re)Assoc",
    "EVIL_TWIN": "Evil_Twin", "rogue_ap": "RogueAP", "krook": "Kr00k", "Botnet": None, "": None,
}


def _spelling_sql() -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in SPELLINGS.values()) + "]"


@query(
    "normalise_label",
    with_events(f"SELECT event_id, {_spelling_sql()}[CAST(k % {len(SPELLINGS)} + 1 AS BIGINT)] AS label FROM e"),
)
def _label(df):
    raw = F.get(F.array(*[F.lit(s) for s in SPELLINGS]), (F.col("k") % len(SPELLINGS)).cast("int"))
    return df.select("event_id", labels.normalise_label(raw).alias("label"))


@query(
    "norm_mac",
    with_events(
        f"SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE {BSS} END AS mac FROM e"
    ),
)
def _mac(df):
    cell = df.selectExpr(
        "event_id", "format_string('aa:aa:aa:aa:aa:%02x', 1 + user_id % 5) as m"
    ).selectExpr(
        "event_id",
        "case event_id % 4 when 0 then concat(' ', upper(m), ' ') "
        "when 1 then concat(m, ',02:00:00:00:00:01') when 2 then m else '?' end as cell",
    )
    return cell.selectExpr("event_id", f"{cells.norm_mac('cell')} as mac")


@query(
    "mac_bits",
    with_events(
        "SELECT event_id, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS broadcast, "
        "CASE WHEN k % 3 = 0 OR k % 2 = 1 THEN 1 ELSE 0 END AS multicast, "
        "CASE WHEN k % 3 = 0 OR (k // 2) % 2 = 1 THEN 1 ELSE 0 END AS local_admin FROM e"
    ),
)
def _bits(df):
    mac = df.selectExpr(
        "event_id", "if(k % 3 = 0, 'FF:FF:FF:FF:FF:FF', format_string('%02x:00:00:01:00:%02x', k, k)) as mac"
    )
    return mac.selectExpr(
        "event_id",
        f"{cells.mac_is_broadcast('mac')} as broadcast",
        f"{cells.mac_is_group('mac')} as multicast",
        f"{cells.mac_is_local('mac')} as local_admin",
    )


# ---- radio ---------------------------------------------------------------------------

_F = "2400 + (event_id * 37) % 4800"


@query(
    "freq_to_channel",
    with_events(
        f"SELECT event_id, CAST(CASE WHEN f = 2484 THEN 14 WHEN f BETWEEN 2412 AND 2472 THEN (f - 2407) // 5 "
        "WHEN f BETWEEN 4910 AND 4980 THEN (f - 4000) // 5 WHEN f BETWEEN 5000 AND 5925 THEN (f - 5000) // 5 "
        f"WHEN f BETWEEN 5955 AND 7115 THEN (f - 5950) // 5 END AS INTEGER) AS channel FROM (SELECT event_id, {_F} AS f FROM e) t"
    ),
)
def _channel(df):
    return df.select("event_id", radio.freq_to_channel(F.expr(_F)).alias("channel"))


@query(
    "freq_to_channel_ui",
    with_events(
        "SELECT event_id, CAST(CASE WHEN f = 2484 THEN 14 "
        "WHEN f BETWEEN 2412 AND 2472 THEN floor((f - 2412) / 5.0 + 0.5) + 1 "
        "WHEN f BETWEEN 5000 AND 5925 THEN floor((f - 5000) / 5.0 + 0.5) "
        "WHEN f BETWEEN 5955 AND 7115 THEN floor((f - 5955) / 5.0 + 0.5) + 1 WHEN f > 0 AND f <= 233 THEN f END AS INTEGER) "
        "AS channel FROM (SELECT event_id, (event_id * 37) % 7200 AS f FROM e) t"
    ),
)
def _channel_ui(df):
    return df.select("event_id", radio.freq_to_channel_ui(F.expr("(event_id * 37) % 7200")).alias("channel"))


_FLAGS = "(event_id * 16) % 4096"
_PHY_SQL = (
    "CASE WHEN k % 17 = 0 THEN 11 WHEN k % 13 = 0 THEN 8 WHEN k % 11 = 0 THEN 7 "
    f"WHEN ({_FLAGS}) & 64 <> 0 THEN CASE WHEN f >= 4000 THEN 5 WHEN f < 3000 THEN 6 END "
    f"WHEN ({_FLAGS}) & 32 <> 0 THEN 4 WHEN ({_FLAGS}) & 2048 <> 0 THEN 1 END"
)


def _phy(df):
    return df.withColumn(
        "phy",
        radio.derive_phy(F.expr("k % 17 = 0"), F.expr("k % 13 = 0"), F.expr("k % 11 = 0"), F.expr(_FLAGS), F.expr(_F)),
    )


@query(
    "derive_phy",
    with_events(f"SELECT event_id, CAST({_PHY_SQL} AS INTEGER) AS phy FROM (SELECT *, {_F} AS f FROM e) t"),
)
def _derive_phy(df):
    return _phy(df).select("event_id", "phy")


@query(
    "radio_duration",
    with_events(
        "SELECT event_id, CAST(CASE WHEN n <= 0 OR r <= 0 THEN NULL "
        "WHEN phy IN (1, 3, 4) THEN CASE WHEN k % 2 = 0 THEN 96 ELSE 192 END + ceil(n * 8.0 / r) "
        "WHEN phy IN (5, 6, 7, 8, 11) THEN 20 + 4 * ceil((22.0 + 8.0 * n) / (r * 4.0)) + CASE WHEN phy = 6 THEN 6 ELSE 0 END "
        "END AS DOUBLE) AS duration_us FROM (SELECT *, "
        f"{_PHY_SQL} AS phy, event_id % 1500 AS n, CAST(k % 4 AS DOUBLE) * 5.5 AS r FROM (SELECT *, {_F} AS f FROM e) a) b"
    ),
)
def _duration(df):
    return _phy(df).select(
        "event_id",
        radio.radio_duration_us(
            "phy", F.expr("event_id % 1500"), F.expr("double(k % 4) * 5.5D"), F.expr("k % 2 = 0")
        ).alias("duration_us"),
    )


@query(
    "mcs_rate",
    with_events(
        "SELECT event_id, round(n * b * c * s / t, 3) AS rate, round(hn * hb * hc * hs / t, 3) AS ht_rate FROM (SELECT event_id, "
        "[52, 108, 234, 468, NULL][CAST(event_id % 5 + 1 AS BIGINT)]::DOUBLE AS n, "
        "[1, 2, 2, 4, 4, 6, 6, 6, 8, 8, 10, 10, NULL][CAST(k % 13 + 1 AS BIGINT)]::DOUBLE AS b, "
        "[0.5, 0.5, 0.75, 0.5, 0.75, 2.0/3, 0.75, 5.0/6, 0.75, 5.0/6, 0.75, 5.0/6, NULL][CAST(k % 13 + 1 AS BIGINT)]::DOUBLE AS c, "
        "CASE WHEN user_id % 10 BETWEEN 1 AND 8 THEN (user_id % 10)::DOUBLE END AS s, "
        "CASE WHEN event_id % 2 = 0 THEN 3.6 ELSE 4.0 END::DOUBLE AS t, "
        "CASE WHEN k % 2 = 0 THEN 108 ELSE 52 END::DOUBLE AS hn, "
        "[1, 2, 2, 4, 4, 6, 6, 6][CAST(k % 36 % 8 + 1 AS BIGINT)]::DOUBLE AS hb, "
        "[0.5, 0.5, 0.75, 0.5, 0.75, 2.0/3, 0.75, 5.0/6][CAST(k % 36 % 8 + 1 AS BIGINT)]::DOUBLE AS hc, "
        "CASE WHEN k % 36 < 32 THEN (k % 36) // 8 + 1 END::DOUBLE AS hs FROM e) x"
    ),
)
def _mcs(df):
    width = F.expr("get(array(20, 40, 80, 160, 60), int(event_id % 5))")
    guard = F.expr("event_id % 2 = 0")
    return df.select(
        "event_id",
        radio.mcs_rate_mbps(F.expr("k % 13"), F.expr("user_id % 10"), width, guard).alias("rate"),
        radio.ht_rate_mbps(F.expr("k % 36"), F.expr("k % 2 = 0"), guard).alias("ht_rate"),
    )


@query(
    "fc_flags",
    with_events(
        "SELECT event_id, CAST((f & 1) + 2 * ((f >> 1) & 1) AS INTEGER) AS ds, CAST((f >> 2) & 1 AS INTEGER) AS frag, "
        "CAST((f >> 3) & 1 AS INTEGER) AS retry, CAST((f >> 4) & 1 AS INTEGER) AS pwrmgt, "
        "CAST((f >> 5) & 1 AS INTEGER) AS moredata, CAST((f >> 6) & 1 AS INTEGER) AS protected, "
        'CAST((f >> 7) & 1 AS INTEGER) AS "order" FROM (SELECT event_id, event_id % 256 AS f FROM e) t'
    ),
)
def _flags(df):
    return df.select("event_id", radio.fc_flags(F.expr("event_id % 256")).alias("f")).select("event_id", "f.*")


@query(
    "ds_addresses",
    with_events(
        "SELECT event_id, CASE WHEN t = 1 THEN NULL WHEN d = 2 THEN 'c' || k WHEN d = 3 THEN 'd' || k ELSE 'b' || k END AS sa, "
        "CASE WHEN t = 1 THEN NULL WHEN d IN (0, 2) THEN 'a' || k ELSE 'c' || k END AS da, "
        "CASE WHEN t = 1 THEN NULL WHEN d = 0 THEN 'c' || k WHEN d = 1 THEN 'a' || k WHEN d = 2 THEN 'b' || k END AS bssid, "
        "'b' || k AS ta, 'a' || k AS ra FROM (SELECT event_id, k, event_id % 3 AS t, user_id % 4 AS d FROM e) x"
    ),
)
def _ds(df):
    a = [F.concat(F.lit(p), F.col("k").cast("string")) for p in "abcd"]
    return df.select(
        "event_id", radio.ds_addresses(F.expr("event_id % 3"), F.expr("user_id % 4"), *a).alias("a")
    ).select("event_id", "a.*")


@query(
    "seq_and_duration",
    with_events(
        "SELECT event_id, s >> 4 AS seq, ((s & 255) << 8) | ((s >> 8) & 255) AS duration "
        "FROM (SELECT event_id, (event_id * 97) % 65536 AS s FROM e) t"
    ),
)
def _seq(df):
    s = F.expr("(event_id * 97) % 65536")
    return df.select("event_id", radio.sequence_number(s).alias("seq"), radio.duration_swap(s).alias("duration"))


@query(
    "eapol_msgnr",
    with_events(
        "SELECT event_id, CAST(CASE WHEN i & 128 <> 0 AND i & 256 <> 0 THEN 3 WHEN i & 128 <> 0 THEN 1 "
        "WHEN i & 256 <> 0 AND (i & 512 <> 0 OR coalesce(n = 0, false)) THEN 4 WHEN i & 256 <> 0 THEN 2 END AS INTEGER) AS msgnr "
        "FROM (SELECT event_id, (event_id * 64) % 1024 AS i, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 3 END AS n FROM e) t"
    ),
)
def _eapol(df):
    info, n = F.expr("(event_id * 64) % 1024"), F.expr("if(k % 5 = 0, null, k % 3)")
    return df.select("event_id", radio.eapol_message(info, n).alias("msgnr"))


@query(
    "chain_signal",
    with_events(
        "SELECT event_id, CASE WHEN k % 10 > 0 THEN -31.0 - k % 40 END::DOUBLE AS last, "
        "CASE WHEN k % 10 > 0 THEN -30.0 - k % 40 END::DOUBLE AS strongest, "
        "CASE WHEN k % 10 > 0 THEN -61.0 - 2 * (k % 40) END::DOUBLE AS total FROM e"
    ),
)
def _chain(df):
    cell = "if(k % 10 = 0, null, concat('-', 30 + k % 40, '-', 31 + k % 40))"
    chains = df.selectExpr("event_id", f"{cell} as cell").selectExpr("event_id", f"{cells.parse_multi('cell')} as xs")
    return chains.select("event_id", radio.chain_signal("xs").alias("c")).select("event_id", "c.*")


# ---- class names ----------------------------------------------------------------------

NAMES = {
    "Deauth": ("deauth", "deauth", "deauth", "high"),
    "(Re)Assoc": ("reassoc", "reassoc", "reassoc", "info"),
    "Evil_Twin": ("evil_twin", "evil_twin", "evil_twin", "critical"),
    "RogueAP": ("rogueap", "rogueap", "rogueap", "high"),
    "Kr00k": ("kr00k", "kr00k", "kr00k", "critical"),
    "Weird_Label": ("weird_label", "other", "other", "info"),
    "Disassociation": ("disassociation", "other", "disas", "high"),
    "twin": ("twin", "other", "evil_twin", "critical"),
}


def _name(df):
    return df.withColumn("name", F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("k") % len(NAMES)).cast("int")))


def _names_sql(i: int) -> str:
    return "[" + ", ".join(f"'{v[i]}'" for v in NAMES.values()) + f"][CAST(k % {len(NAMES)} + 1 AS BIGINT)]"


@query(
    "front_key",
    with_events(f"SELECT event_id, {_names_sql(0)} AS key, {_names_sql(1)} AS front_type FROM e"),
)
def _front(df):
    return _name(df).select(
        "event_id", labels.front_key("name").alias("key"), labels.front_type("name").alias("front_type")
    )


@query("attack_type", with_events(f"SELECT event_id, {_names_sql(2)} AS type FROM e"))
def _type(df):
    return _name(df).select("event_id", labels.attack_type("name").alias("type"))


@query("severity", with_events(f"SELECT event_id, {_names_sql(3)} AS severity FROM e"))
def _severity(df):
    return _name(df).select("event_id", labels.severity(labels.attack_type("name")).alias("severity"))


PHRASES = {
    "Deauth": "Deauth", "  (re)assoc ": "(Re)Assoc", "Evil twin": "Evil_Twin", "CVE-2019-15126": "Kr00k",
    "Key Reinstallation attack!": "Krack", "deauthentication flood": "Deauth", "deauth": "Deauth",
    "weather today": None, "": None, "rogue access point": "RogueAP", "upnp": "SSDP",
}


@query(
    "resolve_class",
    with_events(
        "SELECT event_id, ["
        + ", ".join("NULL" if v is None else f"'{v}'" for v in PHRASES.values())
        + f"][CAST(k % {len(PHRASES)} + 1 AS BIGINT)] AS class FROM e"
    ),
)
def _resolve(df):
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("k") % len(PHRASES)).cast("int"))
    return df.select("event_id", labels.resolve_class(phrase).alias("class"))


# ---- time and text ---------------------------------------------------------------------


@query(
    "api_time",
    with_events(
        f"SELECT event_id, {stamp_sql('t')} AS t FROM (SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL "
        "WHEN 4 THEN date_trunc('second', ts) - INTERVAL 3 HOUR ELSE date_trunc('second', ts) END AS t FROM e) x"
    ),
)
def _time(df):
    text = df.selectExpr(
        "event_id",
        """case event_id % 6 when 0 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') when 1 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
        when 2 then string(unix_seconds(ts)) when 3 then string(unix_seconds(ts) * 1000)
        when 4 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+03:00'") else 'soon' end as t""",
    )
    return text.select("event_id", stamp(timeparts.api_time("t")).alias("t"))


_HIDDEN = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}]"
_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


@query(
    "text_admissible",
    "SELECT doc_id, CASE WHEN length(t) > 4000 THEN 'too_long' "
    f"WHEN regexp_matches(t, '{_CONTROL}') AND NOT regexp_matches(regexp_extract(t, '(?s)^(.*?){_CONTROL}', 1), '{_HIDDEN}') "
    f"THEN 'control_character' WHEN regexp_matches(t, '{_HIDDEN}') THEN 'hidden_character' "
    "WHEN trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' END AS reason FROM (SELECT doc_id, "
    "CASE doc_id % 7 WHEN 1 THEN text || chr(8203) WHEN 2 THEN chr(27) || text WHEN 3 THEN chr(8238) || text || chr(7) "
    "WHEN 4 THEN ' ' || chr(10) ELSE text END AS t FROM documents) d",
    source=lambda spark, sf_dir: table(spark, sf_dir, "documents"),
)
def _admissible(df):
    text = df.selectExpr(
        "doc_id",
        """case doc_id % 7 when 1 then concat(text, '\\u200b') when 2 then concat('\\u001b', text)
        when 3 then concat('\\u202e', text, '\\u0007') when 4 then ' \\n' else text end as t""",
    )
    return text.select("doc_id", payload.text_admissible("t", 4000).alias("reason"))


# ---- decisions -------------------------------------------------------------------------


def _logits(spark, sf_dir):
    # Spread out, so that the thresholds are met from both sides.
    emb = table(spark, sf_dir, "embeddings")
    return emb.selectExpr("vec_id", "transform(slice(embedding, 1, 9), x -> double(x) * 25D) as logits")


_SOFTMAX_CTE = (
    "l AS (SELECT vec_id, [x::DOUBLE * 25 FOR x IN embedding[1:9]] AS z FROM embeddings), "
    "p AS (SELECT vec_id, [exp(x - list_max(z)) FOR x IN z] AS q FROM l), "
    "s AS (SELECT vec_id, [x / list_sum(q) FOR x IN q] AS p FROM p)"
)


@query(
    "softmax",
    f"WITH {_SOFTMAX_CTE} SELECT vec_id, [round(x, 9) FOR x IN p] AS p FROM s",
    source=_logits,
)
def _softmax(df):
    p = verdicts.softmax("logits")
    return df.select("vec_id", F.transform(p, lambda x: F.round(x, 9)).alias("p"))


_ATTACKS = "['Deauth', 'Disas', '(Re)Assoc', 'RogueAP', 'Krack', 'Kr00k', 'Evil_Twin', 'SSDP']"


def _show(v):
    return [
        F.col(f"{v}.is_attack").alias("is_attack"),
        F.col(f"{v}.label").alias("label"),
        F.round(f"{v}.p1", 9).alias("p1"),
        F.round(f"{v}.p2", 9).alias("p2"),
        F.col(f"{v}.stage").alias("stage"),
    ]


@query(
    "verdict",
    f"WITH {_SOFTMAX_CTE}, v AS (SELECT vec_id, 1 - p[1] AS p1, list_max(p[2:9]) AS p2, "
    "list_position(p[2:9], list_max(p[2:9])) AS i FROM s) "
    f"SELECT vec_id, coalesce(p1 >= 0.4 AND p2 >= 0.8, false) AS is_attack, CASE WHEN p1 >= 0.4 THEN {_ATTACKS}[i] END AS label, "
    "round(p1, 9) AS p1, CASE WHEN p1 >= 0.4 THEN round(p2, 9) END AS p2, CASE WHEN p1 >= 0.4 THEN 2 ELSE 1 END AS stage FROM v",
    source=_logits,
)
def _verdict(df):
    return df.select("vec_id", verdicts.verdict(verdicts.softmax("logits")).alias("v")).select("vec_id", *_show("v"))


@query(
    "verdict_two_stage",
    f"WITH {_SOFTMAX_CTE}, v AS (SELECT vec_id, CASE WHEN vec_id % 20 = 0 THEN NULL ELSE 1 - p[1] END AS p1, p[2:9] AS c, "
    "list_max(p[2:9]) AS p2, list_position(p[2:9], list_max(p[2:9])) AS i FROM s) "
    f"SELECT vec_id, coalesce(p1 >= 0.4 AND p2 >= 0.6, false) AS is_attack, CASE WHEN p1 >= 0.4 THEN {_ATTACKS}[i] END AS label, "
    "round(p1, 9) AS p1, CASE WHEN p1 >= 0.4 THEN round(p2, 9) END AS p2, "
    "CASE WHEN p1 IS NULL THEN 0 WHEN p1 >= 0.4 THEN 2 ELSE 1 END AS stage FROM v",
    source=_logits,
)
def _two_stage(df):
    p = df.select("vec_id", verdicts.softmax("logits").alias("p"))
    p1 = F.when(F.col("vec_id") % 20 != 0, 1.0 - F.get("p", F.lit(0)))
    v = verdicts.verdict_two_stage(p1, F.slice("p", 2, 8), spec.ATTACK_CLASSES, thr2=0.6)
    return p.select("vec_id", v.alias("v")).select("vec_id", *_show("v"))


@query(
    "attacks_only",
    f"WITH {_SOFTMAX_CTE} SELECT vec_id FROM s WHERE 1 - p[1] >= 0.4 AND list_max(p[2:9]) >= 0.8",
    source=_logits,
)
def _attacks_only(df):
    scored = df.withColumn("verdict", verdicts.verdict(verdicts.softmax("logits")))
    return attacks_only(scored).select("vec_id")


@query(
    "standardise_mask",
    "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem), "
    "s AS (SELECT avg(q) AS m, stddev_pop(q) AS d FROM x) SELECT l_orderkey, l_linenumber, l_partkey, "
    "round(CASE WHEN q IS NULL THEN -1.0 ELSE least(greatest((q - m) / d, -1.5), 1.5) END, 6) AS z, "
    "CASE WHEN q IS NULL THEN 1 ELSE 0 END AS absent FROM x, s",
    source=lambda spark, sf_dir: table(spark, sf_dir, "lineitem"),
)
def _standardise(df):
    x = df.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_partkey") % 10 != 0, F.col("l_quantity")).alias("q"),
    )
    stats = x.agg(F.avg("q").alias("m"), F.stddev_pop("q").alias("d"))
    z = verdicts.standardise("q", F.col("m"), F.col("d"), clamp=1.5, sentinel=-1.0)
    return x.crossJoin(stats).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(z, 6).alias("z"), verdicts.absent_mask("q").alias("absent")
    )


@query(
    "sql_functions",
    with_events(
        f"SELECT event_id, {SRC} AS mac, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS has_len, 8.0::DOUBLE + k AS tag_total, "
        "CASE event_type WHEN 'signup' THEN 'Deauth' WHEN 'error' THEN 'Evil_Twin' WHEN 'purchase' THEN 'SSDP' ELSE 'Normal' END AS label "
        "FROM e"
    ),
    source=lambda spark, sf_dir: raw_frames(spark, sf_dir),
)
def _sql_functions(df):
    registry.register(df.sparkSession)
    return df.selectExpr(
        "frame_number as event_id",
        "wl_mac(wlan_sa) as mac",
        "wl_present(frame_len) as has_len",
        "reduce(wl_numbers(wlan_tag_length), 0D, (a, x) -> a + x) as tag_total",
        "wl_label(raw_label) as label",
    )


"""Cell parsing, class names and radio arithmetic on crafted values."""

import pytest
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions import cells, labels, payload, radio, registry, timeparts, verdicts


def evaluate(spark, values, sql_or_column, schema="c string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    column = F.expr(sql_or_column) if isinstance(sql_or_column, str) else sql_or_column
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


NUMBERS = {
    "0-8-26-12": [0, 8, 26, 12],
    "-29-32-29": [-29, -32, -29],
    "1-0-0": [1, 0, 0],
    "0x1f": [31],
    "0X1F": [31],
    "0x": [],
    "": [],
    " \t\n": [],
    "?": [],
    "-": [],
    "nan": [],
    "None": [],
    "a,2,3": [2, 3],
    " 7 , x , 8.5": [7, 8.5],
    "1e3": [1000],
    "1e-3": [0.001],
    "+5": [5],
    ".5": [0.5],
    "1.": [1],
    "1d": [],
    "0x1p3": [],
    "-5abc9": [-5, 9],
    "2437": [2437],
    None: [],
}


def test_parse_multi(spark):
    got = evaluate(spark, list(NUMBERS), cells.parse_multi("c"))
    assert got == [[float(x) for x in v] for v in NUMBERS.values()]


def test_first_number_is_the_head_of_parse_multi(spark):
    got = evaluate(spark, list(NUMBERS), cells.first_number("c"))
    assert got == [float(v[0]) if v else None for v in NUMBERS.values()]


def test_sum_and_int(spark):
    assert evaluate(spark, ["0-8-26-12", "", "2.9", "-2.9"], cells.sum_number("c")) == [46.0, None, 2.9, -2.9]
    assert evaluate(spark, ["2.9", "-2.9", "?"], cells.first_int("c")) == [2, -2, None]


def test_present_and_none_text(spark):
    # "None" is a value for presence but no number.
    assert evaluate(spark, ["x", "", "?", "NaN", "None", None, " - "], cells.present("c")) == [1, 0, 0, 0, 1, 0, 0]


def test_macs(spark):
    macs = ["FF:FF:FF:FF:FF:FF", " 02:00:00:00:00:5F ", "01:00:5e:00:00:01", "zz:00", "", None, "aa:bb,cc:dd", ",aa"]
    assert evaluate(spark, macs, cells.norm_mac("c")) == [
        "ff:ff:ff:ff:ff:ff", "02:00:00:00:00:5f", "01:00:5e:00:00:01", "zz:00", None, None, "aa:bb", None,
    ]
    assert evaluate(spark, macs, cells.mac_is_broadcast("c")) == [1, 0, 0, 0, 0, 0, 0, 0]
    assert evaluate(spark, macs, cells.mac_is_group("c"))[:4] == [1, 0, 1, 0]
    assert evaluate(spark, macs, cells.mac_is_local("c"))[:4] == [1, 1, 0, 0]


def test_labels(spark):
    raw = ["Deauth", "SDDP", "Kr00K", " re)assoc ", "Botnet", "", None]
    assert evaluate(spark, raw, labels.normalise_label("c")) == [
        "Deauth", "SSDP", "Kr00k", "(Re)Assoc", None, None, None,
    ]
    assert evaluate(spark, ["(Re)Assoc", "Evil_Twin", "x"], labels.front_type("c")) == ["reassoc", "evil_twin", "other"]
    assert evaluate(spark, ["(Re)Assoc", "Disassociation", None], labels.attack_type("c")) == ["reassoc", "disas", "other"]
    phrases = ["Deauth", "CVE-2019-15126", "tell me about deauth", "deauth", "weather", ""]
    # The class key must be a word of its own in the phrase with blanks as underscores.
    assert evaluate(spark, phrases, labels.resolve_class("c")) == ["Deauth", "Kr00k", None, "Deauth", None, None]


def test_channels(spark):
    freqs = [2412, 2437, 2472, 2484, 4920, 5180, 5745, 5955, 7115, 900]
    assert evaluate(spark, freqs, radio.freq_to_channel("c"), "c int") == [1, 6, 13, 14, 184, 36, 149, 1, 233, None]
    ui = [2412, 2484, 4920, 5180, 5955, 36, 0, -1, 300]
    assert evaluate(spark, ui, radio.freq_to_channel_ui("c"), "c int") == [1, 14, None, 36, 1, 36, None, None, None]


def test_mcs_rate_of_the_published_table(spark):
    got = evaluate(spark, [21], radio.ht_rate_mbps("c", F.lit(False), F.lit(True)), "c int")
    assert got == [173.333]


def test_eapol_messages(spark):
    info = [0x0080, 0x0100, 0x0180, 0x0300, 0x0000]
    assert evaluate(spark, info, radio.eapol_message("c", F.lit(22)), "c int") == [1, 2, 3, 4, None]
    assert evaluate(spark, [0x0100], radio.eapol_message("c", F.lit(0)), "c int") == [4]


@pytest.mark.parametrize(
    "kind, flags, expected",
    [
        (0, 0, ("b", "a", "c")),
        (2, 1, ("b", "c", "a")),
        (2, 2, ("c", "a", "b")),
        (2, 3, ("d", "c", None)),
        (1, 0, (None, None, None)),
    ],
)
def test_ds_table(spark, kind, flags, expected):
    row = (
        spark.range(1)
        .select(radio.ds_addresses(F.lit(kind), F.lit(flags), *[F.lit(x) for x in "abcd"]).alias("a"))
        .first()
        .a
    )
    assert (row.sa, row.da, row.bssid) == expected
    assert (row.ra, row.ta) == ("a", "b")


def test_sim_truthiness(spark):
    raws = ['{"sim": true}', '{"sim": false}', '{"sim": 0}', '{"sim": 2}', '{"sim": "false"}', '{"sim": ""}',
            '{"sim": null}', "{}", "[1]", "junk", None, '{"sim": {}}', '{"sim": [1]}']
    assert evaluate(spark, raws, payload.is_simulated("c")) == [
        True, False, False, True, True, False, False, False, False, False, False, False, True,
    ]


def test_text_admissible(spark):
    texts = ["fine\n\ttext", "x" * 11, "a​b", "a\x07b", "‮a\x07", "\x07‮", "   ", None]
    assert evaluate(spark, texts, payload.text_admissible("c", 10)) == [
        None, "too_long", "hidden_character", "control_character", "hidden_character", "control_character",
        "empty", "not_a_string",
    ]


def test_api_time(spark):
    texts = ["2026-08-24 22:30:00", "2026-08-24T22:30:00Z", "2026-08-25T01:30:00+03:00", "1787610600", "1787610600000", "soon", ""]
    got = evaluate(spark, texts, F.date_format(timeparts.api_time("c"), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-08-24 22:30"] * 5 + [None, None]


def test_zone_crossover_and_unknown_zone(spark):
    local = timeparts.local_time(F.lit("2026-08-24 22:30:00").cast("timestamp"), "Asia/Riyadh")
    row = spark.range(1).select(timeparts.bucket_key(local, "hour").alias("k"), timeparts.day_name(timeparts.day_index(local)).alias("d")).first()
    assert (row.k, row.d) == ("2026-08-25T01", "Tue")
    with pytest.raises(ValueError):
        timeparts.check_zone("Mars/Base")


def test_verdict_rule(spark):
    def one(p):
        v = spark.range(1).select(verdicts.verdict(F.array(*[F.lit(x).cast("double") for x in p])).alias("v")).first().v
        return v.is_attack, v.label, v.stage

    rest = [0.0] * 7
    assert one([0.7, 0.3] + rest) == (False, None, 1)
    assert one([0.1, 0.9] + rest) == (True, "Deauth", 2)
    assert one([0.5, 0.25, 0.25] + [0.0] * 6) == (False, "Deauth", 2)
    assert one([float("nan"), 0.9] + rest) == (False, None, 0)
    assert one([0.2, 0.0, 0.8] + [0.0] * 6)[0] is True


def test_two_stage_probabilities(spark):
    row = spark.range(1).select(
        verdicts.as_probabilities(F.array(F.lit(0.3)), 2).alias("a"),
        verdicts.as_probabilities(F.array(*[F.lit(0.25)] * 4), 4).alias("b"),
    ).first()
    assert row.a == [0.7, 0.3]
    assert row.b == [0.25] * 4


def test_sql_names(spark):
    names = registry.register(spark)
    assert "wl_numbers" in names
    row = spark.sql(
        "select wl_numbers('0-8-26') n, wl_label('SDDP') l, wl_channel(5180) c, wl_front_key('(Re)Assoc') k, wl_severity('krack') s"
    ).first()
    assert (row.n, row.l, row.c, row.k, row.s) == ([0.0, 8.0, 26.0], "SSDP", 36, "reassoc", "critical")


def test_fixed_lists():
    assert len(spec.FEATURES) == 46 and len(spec.MODEL_COLUMNS) == 82
    assert len(set(spec.FLAT_MODEL_COLUMNS)) == 82

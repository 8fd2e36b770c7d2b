"""Radio and MAC-header arithmetic on decoded integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wlanlake.functions.util import col_of, lookup

# Physical layer codes.
PHY_FHSS, PHY_DSSS, PHY_B, PHY_A, PHY_G, PHY_N, PHY_AC, PHY_AX = 1, 3, 4, 5, 6, 7, 8, 11
# Channel flag bits.
CH_CCK, CH_OFDM, CH_GFSK = 0x0020, 0x0040, 0x0800
# Frame control flag bits.
FC_TO_DS, FC_FROM_DS, FC_FRAG, FC_RETRY = 0x01, 0x02, 0x04, 0x08
FC_PWRMGT, FC_MOREDATA, FC_PROTECTED, FC_ORDER = 0x10, 0x20, 0x40, 0x80
# Key information bits of a key frame.
KEY_ACK, KEY_MIC, KEY_SECURE = 0x0080, 0x0100, 0x0200
# Bits per subcarrier and coding rate of each modulation index.
MODULATION = {
    0: (1, 1 / 2), 1: (2, 1 / 2), 2: (2, 3 / 4), 3: (4, 1 / 2), 4: (4, 3 / 4), 5: (6, 2 / 3),
    6: (6, 3 / 4), 7: (6, 5 / 6), 8: (8, 3 / 4), 9: (8, 5 / 6), 10: (10, 3 / 4), 11: (10, 5 / 6),
}
# Data subcarriers of each channel width in MHz.
SUBCARRIERS = {20: 52, 40: 108, 80: 234, 160: 468}


def bit(c, mask: int) -> Column:
    """0/1 for one flag bit, absent flags count as 0."""
    return (F.coalesce(col_of(c), F.lit(0)).bitwiseAND(mask) != 0).cast("int")


def freq_to_channel(freq) -> Column:
    """Channel number of a centre frequency, as the sensor reports it."""
    f = col_of(freq).cast("int")

    def band(lo, hi, base):
        return f.between(lo, hi), F.floor((f - base) / 5).cast("int")

    out = F.when(f == 2484, 14)
    for cond, value in (
        band(2412, 2472, 2407),
        band(4910, 4980, 4000),
        band(5000, 5925, 5000),
        band(5955, 7115, 5950),
    ):
        out = out.when(cond, value)
    return out


def freq_to_channel_ui(freq) -> Column:
    """Channel number as the screens show it: rounds, and lets channel numbers through."""
    f = col_of(freq).try_cast("double")

    def half_up(x):
        return F.floor(x + 0.5).cast("int")

    return (
        F.when(f.isNull() | F.isnan(f) | (f <= 0), None)
        .when(f == 2484, 14)
        .when(f.between(2412, 2472), half_up((f - 2412) / 5) + 1)
        .when(f.between(5000, 5925), half_up((f - 5000) / 5))
        .when(f.between(5955, 7115), half_up((f - 5955) / 5) + 1)
        .when(f <= 233, half_up(f))
    )


def derive_phy(has_he, has_vht, has_mcs, chan_flags, freq) -> Column:
    """Physical layer code from presence bits, channel flags and frequency."""
    flags, f = col_of(chan_flags), col_of(freq)

    def has(mask):
        return flags.bitwiseAND(mask) != 0

    return (
        F.when(col_of(has_he), PHY_AX)
        .when(col_of(has_vht), PHY_AC)
        .when(col_of(has_mcs), PHY_N)
        .when(has(CH_OFDM), F.when(f >= 4000, PHY_A).when(f < 3000, PHY_G))
        .when(has(CH_CCK), PHY_B)
        .when(has(CH_GFSK), PHY_FHSS)
    )


def radio_duration_us(phy, length, rate, short_preamble) -> Column:
    """Air time of a frame in microseconds, NULL when it cannot be told."""
    phy, n, r = col_of(phy), col_of(length), col_of(rate)
    dsss = F.when(col_of(short_preamble), 96.0).otherwise(192.0) + F.ceil(n * 8.0 / r)
    ofdm = 20.0 + 4.0 * F.ceil((22.0 + 8.0 * n) / (r * 4.0))
    value = (
        F.when(phy.isin(PHY_B, PHY_DSSS, PHY_FHSS), dsss)
        .when(phy == PHY_G, ofdm + 6.0)
        .when(phy.isin(PHY_A, PHY_N, PHY_AC, PHY_AX), ofdm)
    )
    return F.when((n > 0) & (r > 0), value.cast("double"))


def mcs_rate_mbps(index, streams, width, short_guard) -> Column:
    """Data rate of a modulation index, stream count, channel width and guard interval."""
    idx, nss = col_of(index).cast("int"), col_of(streams).cast("int")
    bits = lookup({k: float(v[0]) for k, v in MODULATION.items()}, idx)
    coding = lookup({k: float(v[1]) for k, v in MODULATION.items()}, idx)
    tones = lookup({k: float(v) for k, v in SUBCARRIERS.items()}, col_of(width).cast("int"))
    symbol = F.when(col_of(short_guard), 3.6).otherwise(4.0)
    return F.when(nss.between(1, 8), F.round(tones * bits * coding * nss / symbol, 3))


def ht_rate_mbps(ht_index, wide, short_guard) -> Column:
    """Rate of a high-throughput index, which holds modulation and stream count together."""
    i = col_of(ht_index).cast("int")
    width = F.when(col_of(wide), 40).otherwise(20)
    streams = F.floor(i / 8).cast("int") + 1
    return F.when(i < 32, mcs_rate_mbps(F.pmod(i, F.lit(8)), streams, width, short_guard))


def fc_flags(c) -> Column:
    """Frame control flags as a struct."""
    return F.struct(
        (bit(c, FC_TO_DS) + 2 * bit(c, FC_FROM_DS)).alias("ds"),
        bit(c, FC_FRAG).alias("frag"),
        bit(c, FC_RETRY).alias("retry"),
        bit(c, FC_PWRMGT).alias("pwrmgt"),
        bit(c, FC_MOREDATA).alias("moredata"),
        bit(c, FC_PROTECTED).alias("protected"),
        bit(c, FC_ORDER).alias("order"),
    )


def ds_addresses(frame_type, flags, addr1, addr2, addr3, addr4) -> Column:
    """Source, destination, BSSID, transmitter and receiver from the four address fields.

    Which field holds which depends on the two distribution bits; control frames name
    only receiver and transmitter.
    """
    a1, a2, a3, a4 = (col_of(a) for a in (addr1, addr2, addr3, addr4))
    ds = bit(flags, FC_TO_DS) + 2 * bit(flags, FC_FROM_DS)
    # A frame without a type is not a control frame.
    carries = F.coalesce(col_of(frame_type) != 1, F.lit(True))

    def by_ds(none, to, frm, both):
        picked = F.when(ds == 0, none).when(ds == 1, to).when(ds == 2, frm).otherwise(both)
        return F.when(carries, picked)

    return F.struct(
        by_ds(a2, a2, a3, a4).alias("sa"),
        by_ds(a1, a3, a1, a3).alias("da"),
        by_ds(a3, a1, a2, F.lit(None).cast("string")).alias("bssid"),
        a2.alias("ta"),
        a1.alias("ra"),
    )


def sequence_number(sequence_control) -> Column:
    """Sequence number: the upper twelve bits of sequence control."""
    return F.shiftright(col_of(sequence_control), 4)


def duration_swap(raw) -> Column:
    """Swap the two bytes of a duration read in the wrong byte order."""
    c = col_of(raw)
    return F.shiftleft(c.bitwiseAND(0xFF), 8).bitwiseOR(F.shiftright(c, 8).bitwiseAND(0xFF))


def eapol_message(key_info, data_len) -> Column:
    """Number of a four-way-handshake message, NULL for other key frames."""
    ack, mic, secure = (bit(key_info, m) == 1 for m in (KEY_ACK, KEY_MIC, KEY_SECURE))
    no_data = F.coalesce(col_of(data_len) == 0, F.lit(False))
    return F.when(ack & mic, 3).when(ack, 1).when(mic & (secure | no_data), 4).when(mic, 2)


def chain_signal(chains) -> Column:
    """Last, strongest and summed signal of an antenna-chain array; NULLs when empty."""
    xs = col_of(chains)
    some = F.size(xs) > 0
    return F.struct(
        F.when(some, F.try_element_at(xs, F.lit(-1))).alias("last"),
        F.when(some, F.array_max(xs)).alias("strongest"),
        F.when(some, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)).alias("total"),
    )

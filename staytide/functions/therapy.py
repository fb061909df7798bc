"""Oxygen-therapy types from charted text and numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staytide.functions.values import as_col

EARLIEST_MINUTE = -60


@dataclass(frozen=True)
class TextRule:
    """A text belongs to `kind` if it equals one of `exact`, or holds one of `holds` and not `without`."""

    kind: int
    exact: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()
    guarded: tuple[tuple[str, str], ...] = ()  # (held, but without this)


# Texts of each therapy type, lower case.
THERAPY_RULES: tuple[TextRule, ...] = (
    # invasive
    TextRule(
        kind=4,
        exact=("plateau pressure", "postion at lip", "position at lip", "pressure control"),
        holds=(
            "set vt", "sputum", "rsbi", "tube", "ett", "endotracheal", "tracheal suctioning",
            "tracheostomy", "reintubation", "assist controlled", "volume controlled",
            "pressure controlled", "trach collar",
        ),
    ),
    # not invasive
    TextRule(
        kind=3,
        exact=("bi-pap", "ambubag"),
        holds=(
            "ipap", "niv", "epap", "mask leak", "volume assured", "non-invasive ventilation", "cpap",
        ),
    ),
    # either of the two
    TextRule(
        kind=2,
        exact=(
            "flowtrigger", "peep", "tv/kg ibw", "mean airway pressure", "peak insp. pressure",
            "exhaled mv", "exhaled tv (machine)", "exhaled tv (patient)", "flow sensitivity",
            "peak flow", "f total", "pressure to trigger ps", "adult con setting set rr",
            "adult con setting set vt", "vti", "exhaled vt", "adult con alarms hi press alarm", "mve",
            "respiratory phase", "inspiratory pressure, set", "a1: high exhaled vt",
            "set fraction of inspired oxygen (fio2)", "insp flow (l/min)",
            "adult con setting spont exp vt", "spont tv", "pulse ox results vt",
            "vt spontaneous (ml)", "peak pressure", "ltv1200", "tc",
        ),
        holds=(
            "tidal", "flow rate", "minute volume", "leak", "pressure support", "peep", "tidal volume",
        ),
        guarded=(("vent", "hyperventilat"),),
    ),
    # supplemental oxygen
    TextRule(
        kind=1,
        exact=(
            "t-piece", "blow-by", "oxyhood", "nc", "oxymizer", "hfnc", "oximizer", "high flow",
            "oxymask", "nch", "hi flow", "hiflow", "hhfnc", "nasal canula", "face tent",
            "high flow mask", "aerosol mask", "venturi mask", "cool aerosol mask", "simple mask",
            "face mask",
        ),
        holds=("nasal cannula", "non-rebreather", "nasal mask", "face tent"),
    ),
    # some oxygen therapy
    TextRule(
        kind=0,
        exact=("pressure support", "rr spont", "ps", "insp cycle off (%)", "trach mask/collar"),
        holds=("spontaneous", "oxygen therapy"),
    ),
    # more oxygen than in room air
    TextRule(kind=-1, exact=("lpm o2",)),
)

# Labels whose value is itself a device text, and labels of measured oxygen shares.
DEVICE_LABELS = ("o2 device", "respiratory device", "ventilator type", "oxygen delivery method")
OXYGEN_SHARE_LABELS = ("fio2", "fio2 (%)")
OXYGEN_FLOW_LABELS = ("O2 L/%",)


def any_of(text: Column | str, parts: Sequence[str]) -> Column:
    """True where the text holds one of the parts; parts are plain text."""
    text = as_col(text)
    out = F.lit(False)
    for part in parts:
        out = out | text.contains(part)
    return out


def holds_without(text: Column | str, held: str, without: str) -> Column:
    return as_col(text).contains(held) & ~as_col(text).contains(without)


def rule_matches(text: Column | str, rule: TextRule) -> Column:
    text = as_col(text)
    test = text.isin(*rule.exact) if rule.exact else F.lit(False)
    if rule.holds:
        test = test | any_of(text, rule.holds)
    for held, without in rule.guarded:
        test = test | holds_without(text, held, without)
    return test


def therapy_types(lowered: Column | str, rules: Sequence[TextRule] = THERAPY_RULES) -> Column:
    """All types of a lower-case text, as an array."""
    return F.array_compact(
        F.array(*[F.when(rule_matches(lowered, rule), F.lit(rule.kind)) for rule in rules])
    )


def with_therapy_types(df: DataFrame, text: str, out: str = "types") -> DataFrame:
    """Adds all types each text belongs to, of any case.

    The lower-case text is a step of its own: the many tests read it, and must not each make it.
    """
    lowered = df.withColumn("_lowered", F.lower(text))
    return lowered.withColumn(out, therapy_types("_lowered")).drop("_lowered")


def oxygen_share_type(share: Column | str) -> Column:
    """Measured oxygen share, as a fraction or per cent: -1 above room air, 0 below, NULL for room air."""
    share = as_col(share)
    above = ((share > 0.22) & (share <= 1)) | (share > 22)
    odd = (share < 0.2) | ((share > 0.22) & (share < 20)) | (share > 22)
    return F.when(~F.isnan(share) & odd, F.when(above, F.lit(-1)).otherwise(F.lit(0)))


def oxygen_flow_type(flow: Column | str) -> Column:
    """Oxygen flow within (0, 100] counts as extra oxygen."""
    flow = as_col(flow)
    return F.when(~F.isnan(flow) & (flow > 0) & (flow <= 100), F.lit(-1))

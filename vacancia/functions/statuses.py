"""Application statuses: labels, keys, and what a change of status says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, which of them are final, and the key of each.
STATUS_LABELS = (
    "Applied", "Screening Booked", "Screening Done", "HM interview Booked", "HM interview Done", "More interviews Booked", "More interviews Done",
    "Rejected with Filled", "Rejected with Unfortunately", "Withdrew Applications", "Got Offer", "Accepted Offer", "Turned down Offer", "Ignored",
)
FINAL_STATUSES = ("Rejected with Filled", "Rejected with Unfortunately", "Accepted Offer", "Turned down Offer", "Withdrew Applications", "Ignored")
KEYS = {
    "applied": ("applied",),
    "booked-screen": ("screening booked",),
    "booked-hm": ("hm interview booked",),
    "booked-more": ("more interviews booked",),
    "done-screen": ("screening done",),
    "done-hm": ("hm interview done",),
    "done-more": ("more interviews done",),
    "offer": ("got offer",),
    "accepted": ("accepted offer",),
    "finished": ("rejected with filled", "rejected with unfortunately", "turned down offer", "withdrew applications", "ignored"),
}
#: The database's own keys accept the singular too.
SINGULAR = {"booked-more": ("more interview booked",), "done-more": ("more interview done",)}
NEXT = {
    "": "Applied", "unset": "Applied", "applied": "Screening Booked", "screening booked": "Screening Done", "screening done": "HM interview Booked",
    "hm interview booked": "HM interview Done", "hm interview done": "Got Offer", "more interviews booked": "More interviews Done",
    "more interviews done": "Got Offer", "got offer": "Accepted Offer", "accepted offer": "Turned down Offer", "rejected with unfortunately": "Ignored",
}


def _keyed(label: Column, extra: dict[str, tuple[str, ...]]) -> Column:
    text, out = F.lower(F.trim(label)), None
    for key, labels in KEYS.items():
        test = text.isin(*labels, *extra.get(key, ()))
        out = F.when(test, key) if out is None else out.when(test, key)
    return out


def status_key(label: Column) -> Column:
    """The key of a label; ``unset`` for none, a blank or Unset, ``default`` for others."""
    blank = label.isNull() | (F.trim(label) == "") | (F.lower(F.trim(label)) == "unset")
    return F.when(blank, "unset").otherwise(F.coalesce(_keyed(label, {}), F.lit("default")))


def status_key_sql(label: Column) -> Column:
    """The database's key: singular labels count too, only a missing label is ``unset``."""
    return F.when(label.isNull(), "unset").otherwise(F.coalesce(_keyed(label, SINGULAR), F.lit("default")))


def suggest_next(label: Column) -> Column:
    """The label that usually follows; Applied for labels without one."""
    table = F.create_map(*[F.lit(x) for pair in NEXT.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.trim(F.coalesce(label, F.lit(""))))), F.lit("Applied"))


def suggest_actions(label: Column) -> Column:
    """The usual next label and a second choice."""
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    second = F.when(text.isin("", "unset"), "Ignored").when(text == "rejected with unfortunately", "Applied").otherwise("Rejected with Unfortunately")
    return F.array(suggest_next(label), second)


def clean_label(label: Column) -> Column:
    """White space squashed, at most 100 characters; null where nothing is left."""
    return F.nullif(F.left(F.trim(F.regexp_replace(label, r"\s+", " ")), F.lit(100)), F.lit(""))


def status_from_history(action: Column, details: Column) -> Column:
    """The new status of a history row: ``status:<label>``, or the first text among to, status, data.to and data.status."""

    def text(path: str) -> Column:
        parsed = F.try_parse_json(details)
        return F.when(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING", F.try_variant_get(parsed, path, "string"))

    changed = action.isin("status-changed", "status_changed")
    return F.when(action.startswith("status:") & (F.length(action) > 7), F.substring(action, 8, 1000)).when(changed, F.coalesce(text("$.to"), text("$.status"), text("$.data.to"), text("$.data.status")))

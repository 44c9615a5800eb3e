"""Reactions to completed collections: role labels and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.artifacts.system import role_label
from siftlake.functions import text
from siftlake.operators.rules import any_matches

# Fixed value: results that say what kind of machine a client is.
ENROLMENT = "Generic.Client.Info/WindowsInfo|Generic.Client.Info/BasicInformation"


def labels(completions: DataFrame, ts: str) -> DataFrame:
    """(client_id, label, first_seen) of completed enrolment collections, for update mode.
    Repeats of a client are combined before the shuffle, and the state holds one row per
    client. Setting a label again is harmless, so an earlier time may update its row."""
    enrolled = completions.where(any_matches(F.col("artifacts_with_results"), ENROLMENT))
    labelled = enrolled.withColumn("label", role_label(F.col("os"), F.col("domain_role"))).where("label is not null")
    return labelled.groupBy("client_id", "label").agg(F.min(ts).alias("first_seen"))


def exports(completions: DataFrame, ts: str, artifact_regex: str = ".", per_flow_folder: bool = False,
            clients: DataFrame | None = None) -> DataFrame:
    """Name of the export of every completed flow with a matching artifact. With `clients`
    (client_id, fqdn; unique by client_id), a table that each batch reads anew, the name of a
    client comes from there; a client that it does not know goes by its id."""
    done = completions.where(any_matches(F.col("artifacts_with_results"), artifact_regex))
    if clients is not None:
        done = done.drop("fqdn").join(clients.select("client_id", "fqdn"), "client_id", "left").withColumn(
            "fqdn", F.coalesce("fqdn", F.col("client_id").cast("string")))
    return done.select("client_id", "flow_id", text.flow_export_name(
        F.col("fqdn"), F.col("flow_id"), F.date_format(ts, "yyyyMMdd"), per_flow_folder).alias("export_name"))

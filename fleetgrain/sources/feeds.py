"""Vehicle-position feed, trip roster and delimited text readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrain.functions.status import nonnegative_speed, valid_position
from fleetgrain.functions.text import decimal_comma, normalize_line, text_or_null
from fleetgrain.functions.times import source_timestamp

# rows stay JSON text: an array-of-arrays schema would null the whole list for one bad row
ENVELOPE = "campos array<string>, dados array<string>"
ROSTER = "viagens array<string>"
_ROSTER_FIELDS = (
    "veiculo", "inicioProgramado", "inicioRealizado", "fimProgramado", "fimRealizado",
    "nomePontoInicio", "nomePontoFim", "codAtendimento", "atividade", "tabela", "linha",
    "sentido", "tipoDia", "numeroViagem",
)


def read_envelopes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Poll files as envelopes with their file as batch id and a receive time."""
    reader = spark.readStream.option("maxFilesPerTrigger", 1) if streaming else spark.read
    envelopes = reader.schema(ENVELOPE).option("multiLine", True).json(path)
    return envelopes.select(
        "campos", "dados", F.col("_metadata.file_path").alias("batch_id"),
        F.col("_metadata.file_modification_time").alias("received_at"),
    )


def parse_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row per feed record with its position, source map and rejection.

    Rejected: not a list, wrong length, or no vehicle prefix. Unknown fields
    stay in `source_data`.
    """
    kept = [c for c in envelopes.columns if c not in ("campos", "dados")]
    rows = envelopes.select(*kept, "campos", F.posexplode("dados").alias("pos", "record"))
    is_list = F.ltrim("record").startswith("[")
    values = F.when(is_list, F.from_json("record", "array<string>"))
    sized = rows.withColumn("_values", values).withColumn(
        "_fits", F.coalesce(F.size("_values") == F.size("campos"), F.lit(False))
    )
    source = F.when(F.col("_fits"), F.map_from_arrays("campos", "_values"))
    mapped = sized.withColumn("source_data", source).withColumn(
        "vehicle_prefix", text_or_null(F.col("source_data")["Prefixo"])
    )
    reason = (
        F.when(~is_list, "not_a_list")
        .when(~F.col("_fits"), "wrong_length")
        .when(F.col("vehicle_prefix").isNull(), "no_prefix")
    )
    return mapped.select(
        *kept, "pos", "vehicle_prefix", "source_data",
        reason.alias("reject_reason"), reason.isNotNull().alias("rejected"),
    )


def read_position_feed(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return parse_envelopes(read_envelopes(spark, path, streaming))


# State column and the feed field it is read from.
TEXT_FIELDS = {
    "imei": "IMEI",
    "current_line": "Linha_atual",
    "current_planned_time": "HoraViagemPlanejada_atual",
    "current_direction": "GTFS_Sentido_atual",
    "current_schedule_position": "posicaoEscala_atual",
    "current_actual_time": "HoraViagemRealizada_atual",
    "next_planned_time": "HoraViagemPlanejada_proxima",
    "next_trip_point": "pontoProxViagem",
    "next_schedule_position": "posicaoEscala_proxima",
    "next_line": "Linha_proxima",
    "next_direction": "GTFS_Sentido_proxima",
    "next_trip_destination": "destino_pontoProxViagem",
}


def state_columns(feed: DataFrame) -> DataFrame:
    """Typed state columns from the source map, the rest at their start values."""

    def field(name: str) -> Column:
        return F.col("source_data")[name]

    position = valid_position(decimal_comma(field("GPS_Latitude")), decimal_comma(field("GPS_Longitude")))
    speed = nonnegative_speed(decimal_comma(field("Velocidade")))
    stamped = feed.select(
        "*", position.alias("_position"), source_timestamp(field("DataHora")).alias("source_timestamp"),
        speed.alias("speed_kmh"),
    )
    event_at = F.coalesce("source_timestamp", "received_at")
    return stamped.select(
        *feed.columns,
        text_or_null(field("DataHora")).alias("timestamp_text"),
        "source_timestamp",
        F.col("_position.latitude").alias("latitude"),
        F.col("_position.longitude").alias("longitude"),
        F.col("_position.valid").alias("location_valid"),
        decimal_comma(field("GPS_Direcao")).alias("gps_direction"),
        "speed_kmh",
        F.when(F.col("speed_kmh") < 1, event_at).alias("low_speed_since"),
        *[text_or_null(field(source)).alias(name) for name, source in TEXT_FIELDS.items()],
        normalize_line(field("Linha_atual")).alias("normalized_current_line"),
        F.lit("fallback_required").alias("correlation_status"),
        F.lit("missing_input").alias("correlation_reason"),
        F.lit(0).alias("correlation_candidate_count"),
        F.lit("collecting").alias("map_match_status"),
        F.lit(1).alias("position_sample_count"),
    )


def parse_roster(payloads: DataFrame) -> DataFrame:
    """Roster trips as typed rows; non-objects and trips without a vehicle are skipped."""
    schema = ", ".join(f"{f} string" for f in _ROSTER_FIELDS)
    trips = payloads.select(F.explode("viagens").alias("raw")).filter(F.ltrim("raw").startswith("{"))
    t = trips.select(F.from_json("raw", schema).alias("t")).select("t.*")

    def moment(name: str) -> Column:
        text = F.trim(name)
        return source_timestamp(F.when(text.rlike(r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"), text))

    return t.select(
        text_or_null(F.col("veiculo")).alias("vehicle_prefix"),
        moment("inicioProgramado").alias("planned_start_at"),
        moment("inicioRealizado").alias("actual_start_at"),
        moment("fimProgramado").alias("planned_end_at"),
        moment("fimRealizado").alias("actual_end_at"),
        text_or_null(F.col("nomePontoInicio")).alias("origin_name"),
        text_or_null(F.col("nomePontoFim")).alias("destination_name"),
        text_or_null(F.col("codAtendimento")).alias("attendance_code"),
        text_or_null(F.col("atividade")).alias("activity"),
        text_or_null(F.col("tabela")).alias("schedule_table"),
        text_or_null(F.col("linha")).alias("line"),
        text_or_null(F.col("sentido")).alias("direction"),
        text_or_null(F.col("tipoDia")).alias("day_type"),
        text_or_null(F.col("numeroViagem")).alias("trip_number"),
    ).filter("vehicle_prefix IS NOT NULL")


def read_trip_roster(spark: SparkSession, path: str) -> DataFrame:
    return parse_roster(spark.read.schema(ROSTER).option("multiLine", True).json(path))


def read_delimited(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Every column as text, byte-order mark dropped from the first header."""
    return (
        spark.read.option("sep", sep).option("header", True).option("inferSchema", False)
        .option("encoding", "UTF-8").csv(path)
    )

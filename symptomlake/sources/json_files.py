"""Assessment documents kept as one JSON file each."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

# file name pattern of a stored assessment
FILES = "patient_*_assessment_*.json"
PATIENT_OF_ASSESSMENT = "^patient_(.*?)_assessment_"
PATIENT_OF_FILE = r"^patient_([^_]*?)(?:\.json$|_)"   # the part up to the next underscore

DOCUMENT = ("timestamp string, patient_id string, symptoms string, flag_for_oncologist boolean, "
            "flag_reason string, mood_assessment string, conversation_notes string, "
            "oncologist_notification_level string, treatment_status string, _corrupt_record string")


def read_assessment_json(spark: SparkSession, path: str) -> DataFrame:
    """Every readable assessment file, patient id taken from the file name.

    Files that are no JSON are skipped. ``symptoms`` stays text because it comes
    in several shapes; ``flatten_symptoms`` decodes it.
    """
    docs = (spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("pathGlobFilter", FILES).json(path))
    return (docs.withColumn("file_patient_id",
                            F.regexp_extract(F.col("_metadata.file_name"), PATIENT_OF_ASSESSMENT, 1))
            .where(F.col("_corrupt_record").isNull())
            .drop("_corrupt_record"))


def list_patients(spark: SparkSession, path: str) -> DataFrame:
    """S3: distinct patient ids of a file set; only names are read, no contents."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "patient_*.json").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file")))
    return files.select(F.regexp_extract("file", PATIENT_OF_FILE, 1).alias("patient_id")).distinct()


def write_documents(docs: DataFrame, path: str) -> None:
    """One file for each row of ``docs`` (name, body); tasks write their own rows, and a repeated task the same files.

    Spark's writers name files themselves, so the rows go through the file
    system of the path, which all executors must reach.
    """
    def run(batches):
        for batch in batches:
            for name, body in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                with target.open_output_stream(f"{folder}/{name}") as f:
                    f.write(body.encode())
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["n"])

    where = path if "://" in path else "file://" + path.removeprefix("file:")
    target, folder = fs.FileSystem.from_uri(where)
    target.create_dir(folder)
    docs.select("name", "body").mapInArrow(run, "n int").write.format("noop").mode("overwrite").save()

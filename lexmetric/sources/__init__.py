"""Sources and sinks: TSV samples, side files, prediction batches, reports."""

from lexmetric.sources.codes import attach_codes, read_codes  # noqa: F401
from lexmetric.sources.files import (  # noqa: F401
    malformed_prediction_lines,
    malformed_vector_lines,
    read_lines,
    read_parallel_lines,
    read_prediction_batches,
    read_samples,
    read_strict_tsv,
    read_translated,
    read_vectors_text,
    rebuild_output,
    scan_dir,
    write_encoded,
    write_headerless,
    write_lines,
    write_plain_tsv,
    write_prediction_batches,
    write_report,
    write_samples,
    write_vectors_text,
)

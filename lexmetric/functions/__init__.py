"""Column helpers: expressions that stay inside whole-stage codegen."""

from lexmetric.functions.columns import (  # noqa: F401
    LN2,
    WS_CLASS,
    append_token,
    clean_id_string,
    drop_first,
    exact,
    format_exact,
    format_fixed,
    format_repr,
    from_offset,
    ids_to_string,
    l2_normalize,
    length_normalized,
    list_repr,
    output_length_limit,
    padding_mask,
    partial_accuracy,
    render_scores,
    source_length,
    strip_pad,
    strip_text,
    take_prefix,
    to_log2,
    vector_norm,
    words,
)

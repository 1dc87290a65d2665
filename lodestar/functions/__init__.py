"""Column-expression helpers (C1-C14, B1 pattern, hash uniforms)."""

from lodestar.functions.text import (  # noqa: F401
    PRETOKEN_PATTERN, capitalize, first_line, format_path, hash_order_key, hash_uniform,
    join_tokens, nl_key, nl_key_of, normalize_query, pretokens, run_id, strip, strip_newlines,
)
from lodestar.functions.vector import (  # noqa: F401
    angular_distance, as_double, cosine, discount, dot, gain, l2_norm, relu, tanh, target_mask,
)

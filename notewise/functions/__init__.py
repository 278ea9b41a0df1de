from notewise.functions.numeric import (  # noqa: F401
    apply_threshold, array_sum, f1_exact, f1_smoothed, hash_fraction, hash_unit,
    interpolate_vector, safe_div, sigmoid, to_double_array, vector_distance,
)
from notewise.functions.stopwords import (  # noqa: F401
    CLINICAL_EXTRA_STOPWORDS, CLINICAL_STOPWORDS, ENGLISH_STOPWORDS, extend_stopwords,
)
from notewise.functions.text import (  # noqa: F401
    cast_text, clean_text, collapse_ws, contains_any, keyword_regex, lowercase,
    remove_stopwords, strip_digits, strip_punct, tokenize, truncate_tokens, word_length,
)

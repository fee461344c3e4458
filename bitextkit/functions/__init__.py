from bitextkit.functions.text import (  # noqa: F401
    norm_text, clean_text, normalize_for_bleu, strip_ws, add_prompt, latin_share,
    heavy_latin, has_artifact, length_ratio, direction_of, tokenize_13a, chrf_chars,
    chrf_words, ws_tokens, prompt_prefix,
)
from bitextkit.functions.vector import (  # noqa: F401
    cosine, gamma_reward, seq_logprob, log_sigmoid, dpo_margin, dot, l2norm,
)
from bitextkit.functions.hashing import hash_key, coin  # noqa: F401

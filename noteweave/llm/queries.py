"""The subpackage's queries and oracles, by name."""

from noteweave.llm import bpe, chat, crosstok, decontam, langid, neardup, pii, quality, secretscan, substring, suffix, urls, variants

QUERIES = {
    "op1_minhash_dedup": neardup.query,
    "op2_chat_format": chat.query,
    "op3_substring_dedup": substring.query,
    "op4_quality_rules": quality.query,
    "op5_pii_surrogates": pii.query,
    "op6_decontamination": decontam.query,
    "op7_language_id": langid.query,
    "op8_byte_bpe": bpe.query,
    "op9_suffix_array": suffix.query,
    "op10_url_filter": urls.query,
    "op11_spelling_variants": variants.query,
    "op12_cross_tokenizer": crosstok.query,
    "op13_secret_scan": secretscan.query,
}
ORACLES = {
    "op1_minhash_dedup": neardup.oracle(),
    "op2_chat_format": chat.oracle(),
    "op3_substring_dedup": substring.oracle(),
    "op4_quality_rules": quality.oracle(),
    "op9_suffix_array": suffix.oracle(),
    "op10_url_filter": urls.oracle(),
    "op11_spelling_variants": variants.oracle(),
}

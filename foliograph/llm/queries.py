"""The thirteen operators' queries, and DuckDB SQL for those that SQL can express."""

from foliograph.llm import ann, bpe, decontam, exact, langid, licenses, phrases, pii, prefix_trie, quality, simhash, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_decontamination": decontam.op2_decontamination,
        "op3_ann": ann.op3_ann,
        "op4_urlfilter": urlfilter.op4_urlfilter,
        "op5_langid": langid.op5_langid,
        "op6_bpe": bpe.op6_bpe,
        "op7_licenses": licenses.op7_licenses,
        "op8_simhash": simhash.op8_simhash,
        "op9_pii": pii.op9_pii,
        "op10_quality": quality.op10_quality,
        "op11_trie": prefix_trie.op11_trie,
        "op12_phrases": phrases.op12_phrases,
        "op13_exact": exact.op13_exact,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontam.OP2_SQL,
        "op4_urlfilter": urlfilter.OP4_SQL,
        "op11_trie": prefix_trie.OP11_SQL,
        "op12_phrases": phrases.OP12_SQL,
        "op13_exact": exact.OP13_SQL,
    }

"""Registry of the corpus queries: name -> query, and DuckDB SQL where that can express one."""

from __future__ import annotations

from cadencia.llm import alignment, bpe, flac, langid, linededup, maglev, minhash, multiindex, neighbours, packing, phrases, quality, secrets

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_media": flac.op3_media,
    "op4_secrets": secrets.op4_secrets,
    "op5_language": langid.op5_language,
    "op6_sharding": maglev.op6_sharding,
    "op7_packing": packing.op7_packing,
    "op8_lines": linededup.op8_lines,
    "op9_bpe": bpe.op9_bpe,
    "op10_minhash": minhash.op10_minhash,
    "op11_alignment": alignment.op11_alignment,
    "op12_embeddings": multiindex.op12_embeddings,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES: dict[str, str] = {"op13_phrases": phrases.OP13_SQL}

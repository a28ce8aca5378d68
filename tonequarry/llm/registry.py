"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tonequarry.llm import sql
from tonequarry.llm.alignment import op13_token_alignment
from tonequarry.llm.decontamination import op8_decontamination
from tonequarry.llm.embeddings import op9_embeddings
from tonequarry.llm.html_extract import op5_html
from tonequarry.llm.language_id import op2_language_id
from tonequarry.llm.language_model import op1_language_model
from tonequarry.llm.licenses import op3_licenses
from tonequarry.llm.mixing import op12_mixing
from tonequarry.llm.packing import op4_packing
from tonequarry.llm.prefix_trie import op11_prefix_trie
from tonequarry.llm.sharding import op6_sharding
from tonequarry.llm.simhash import op10_simhash
from tonequarry.llm.token_files import op7_token_files

QUERIES = {
    f.__name__: f
    for f in (op1_language_model, op2_language_id, op3_licenses, op4_packing, op5_html, op6_sharding, op7_token_files, op8_decontamination, op9_embeddings, op10_simhash, op11_prefix_trie, op12_mixing, op13_token_alignment)
}

#: The others have none: models, tokenizers, XXH64, crc32 and edit alignment have no form in DuckDB that runs on whole tables in time.
ORACLE_SQL: dict[str, str] = {"op3_licenses": sql.LICENSES, "op9_embeddings": sql.EMBEDDINGS, "op11_prefix_trie": sql.PREFIX_TRIE, "op12_mixing": sql.MIXING}

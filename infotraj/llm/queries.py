"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from infotraj.llm import alignment, bpe, chat, collocations, embeddings, langid, linededup, linefreq, mixing, quality, sharding, simhash, suffixes

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_linefreq": linefreq.op2_linefreq,
    "op3_langid": langid.op3_langid,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_bpe": bpe.op5_bpe,
    "op6_linededup": linededup.op6_linededup,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_chat": chat.op10_chat,
    "op11_alignment": alignment.op11_alignment,
    "op12_suffixes": suffixes.op12_suffixes,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES: dict[str, str] = {
    "op2_linefreq": linefreq.OP2_SQL,
    "op4_embeddings": embeddings.OP4_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_chat": chat.OP10_SQL,
    "op12_suffixes": suffixes.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}

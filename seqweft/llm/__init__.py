"""Operations for preparing text corpora: filters, deduplication, archives and token ids."""

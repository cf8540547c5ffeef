"""Schemas of an archive's tables."""

FILES = "file_id string, file_ord long, original_size long, n_chunks int"
FILE_CHUNKS = "file_id string, file_ord long, pos int, hash string"
CHUNKS = "hash string, original_size long, block_id long, inner_offset long, first_seen long"
BLOCKS = "block_id long, offset long, stored_size long, crc32 long, codec string, encrypted boolean, dictionary_id string, payload binary"
SUMMARY = "version int, name string, total_files long, total_chunks long, dedup_ratio double, storage_ratio double, total_original_bytes long, total_unique_bytes long, total_stored_bytes long, encrypted boolean, dictionary binary, batch_id long"

"""Linking historical person records with Spark DataFrames.

``functions``  column expressions: text cleansing, field rules, travel, conflict rules
``operators``  DataFrame -> DataFrame building blocks: search, vectors, upsert, graph, health
``sources``    landing files, archives and bucketed tables
``plans``      end-to-end compositions: validation, ingest, resolution
``streaming``  the same jobs on Structured Streaming
"""

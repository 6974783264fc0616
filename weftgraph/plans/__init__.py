"""Declarative entity plans and scored pipelines that compile to DataFrames."""

"""rareflow.operators"""

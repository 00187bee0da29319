"""rareflow.sources"""

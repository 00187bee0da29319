"""rareflow.streaming"""

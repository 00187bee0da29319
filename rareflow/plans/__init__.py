"""rareflow.plans"""

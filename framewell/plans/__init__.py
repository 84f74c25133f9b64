"""framewell.plans"""

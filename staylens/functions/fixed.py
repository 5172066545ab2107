"""Word lists and patterns that results must agree on."""

from __future__ import annotations

#: What Python calls white space, as the inside of a character class.
SPACE = "\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

VIETNAMESE_LETTERS = "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ"
VIETNAMESE_WORDS = ["khách sạn", "nhân viên", "phòng", "đẹp", "sạch", "thuận tiện", "đà nẵng", "phú quốc"]
PLAIN_VIETNAMESE_WORDS = ["phong", "khach san", "sach", "tot", "dep", "nhan vien", "ok", "tam"]

SPAM_PHRASES = ["liên hệ", "hotline", "promo code", "mã giảm giá"]

STOPWORDS = ["và", "là", "của", "cho", "được", "với", "nhưng", "rất", "này", "khi", "thì", "có", "ở", "đã", "mình", "chúng", "tôi", "bạn", "không", "ạ", "dạ", "thưa"]
QUERY_STOPWORDS = ["tôi", "mình", "chúng_tôi", "chúng_mình", "ta", "muốn", "cần", "tìm", "kiếm", "tìm_kiếm", "xin", "hãy", "giúp", "cho", "bạn", "ơi", "ở", "tại", "vào", "ra", "và", "hoặc", "hay", "nào", "có", "không", "nhé", "thì", "với", "để", "mà", "về", "thuộc", "trong", "đây", "đó", "gì", "đâu", "sao", "thế_nào", "bao_nhiêu", "thành", "phố", "thành_phố", "khu", "vực", "khu_vực"]

NEGATIVE_PREFIXES = ["!", "not_", "no_", "non_", "bad_", "poor_", "worst_"]
NEGATIVE_TAGS = ["tệ", "tồi_tệ", "dở", "bẩn", "dơ", "ồn", "hôi", "thất_vọng", "không_đáng_tiền", "không_hài_lòng", "tệ_hại", "kinh_khủng", "thảm_họa", "rác_rưởi", "vỡi", "lừa_đảo", "phẫn_nộ", "gay_phẫn"]

POSITIVE_WORDS = ["tốt", "đẹp", "sạch", "thoải_mái", "nhiệt_tình", "thân_thiện", "tiện_nghi", "hợp_lý", "xịn", "mới", "rộng", "gọn_gàng", "chu_đáo", "hài_lòng", "tuyệt_vời", "ok", "ổn", "rộng_rãi", "sạch_sẽ", "tiện_lợi", "thuận_tiện", "vui_vẻ", "dễ_gần", "hỗ_trợ", "yên_tĩnh", "tạm_ổn"]
NEGATIVE_WORDS = ["tệ", "dở", "bẩn", "chật", "nhỏ", "cũ", "hỏng", "kém", "bất_tiện", "xa", "đắt", "ồn", "ồn_ào", "lạnh", "nóng", "thiếu", "kinh_khủng", "khó_chịu", "tối", "gãy", "trống", "nồng", "khó_ngủ", "không_tốt", "cao", "chưa"]

STRONG_COMPLAINTS = ["rất tệ", "quá tệ", "tồi tệ", "thất vọng", "không tốt", "không hài lòng", "bẩn", "dơ", "cũ", "ồn", "mùi hôi", "khó chịu", "không sạch", "không yên tĩnh", "không đáng tiền"]
MILD_COMPLAINTS = ["hơi", "hơi nhỏ", "hơi cũ", "hơi ồn", "hơi bụi", "chưa", "chưa tốt", "không được tốt", "không ổn"]

REVIEW_LIKE = ["dịch vụ", "nhân viên", "sạch sẽ", "lần sau", "quay lại", "view đẹp", "thân thiện", "hỗ trợ", "❤️", "🥲"]
ADDRESS_WORDS = ["phường", "quận", "huyện", "xã", "thành phố", "việt nam"]

#: Categories and what hints at them in a text.
CATEGORY_HINTS = {
    "mountain": ["núi", "đồi", "thung lũng", "cao nguyên", "săn mây", "view núi", "hướng núi"],
    "beach": ["biển", "bãi biển", "ven biển", "gần biển", "đảo", "view biển"],
    "family": ["gia đình", "trẻ em", "family", "kid"],
    "budget": ["giá rẻ", "bình dân", "tiết kiệm", "hợp lý"],
    "luxury": ["sang trọng", "cao cấp", "luxury", "5 sao", "resort", "villa"],
    "center": ["trung tâm", "phố đi bộ", "chợ đêm", "gần chợ", "phố cổ", "hồ gươm", "hồ tây"],
    "amenity_pool": ["hồ bơi", "bể bơi", "pool", "vô cực"],
    "amenity_breakfast": ["ăn sáng", "buffet", "điểm tâm"],
    "airport": ["sân bay", "tân sơn nhất", "nội bài", "ga"],
    "spa_gym": ["gym", "spa", "massage", "thể hình", "xông hơi", "bồn tắm", "jacuzzi"],
    "kitchen": ["bếp", "nấu ăn", "bbq", "nướng"],
    "photo": ["sống ảo", "chụp hình", "vintage", "đẹp", "decor"],
    "quiet": ["yên tĩnh", "nghỉ dưỡng", "đọc sách", "người lớn tuổi"],
    "pet": ["thú cưng", "chó", "mèo", "pet"],
}
#: Categories and the query tokens that ask for them.
CATEGORY_TOKENS = {
    "mountain": ["núi", "đồi", "thung_lũng", "cao_nguyên", "săn_mây", "rừng", "view_núi", "hướng_núi"],
    "beach": ["biển", "bãi_biển", "ven_biển", "gần_biển", "đảo", "view_biển"],
    "family": ["gia_đình", "trẻ_em", "kid", "family", "phòng_gia_đình"],
    "budget": ["giá_rẻ", "bình_dân", "tiết_kiệm", "hợp_lý", "rẻ"],
    "luxury": ["sang_trọng", "cao_cấp", "luxury", "5_sao", "resort", "villa"],
    "center": ["trung_tâm", "phố_đi_bộ", "chợ_đêm", "gần_chợ"],
    "amenity_pool": ["hồ_bơi", "bể_bơi", "pool", "vô_cực"],
    "amenity_breakfast": ["ăn_sáng", "buffet", "điểm_tâm"],
    "airport": ["sân_bay", "airport", "đưa_đón", "xe_đón", "gần_ga", "ga_tàu", "metro"],
    "spa_gym": ["spa", "massage", "gym", "fitness", "xông_hơi", "jacuzzi"],
    "photo": ["sống_ảo", "checkin", "check_in", "chụp_hình", "vintage", "view_đẹp"],
    "quiet": ["yên_tĩnh", "nghỉ_dưỡng", "thư_giãn", "đọc_sách", "riêng_tư"],
    "pet": ["pet", "pet_friendly", "thú_cưng", "đưa_thú_cưng"],
    "kitchen": ["bếp_nấu", "bếp_riêng", "bbq", "nướng", "kitchen"],
    "business": ["công_tác", "business", "workation", "phòng_họp", "meeting", "co_working"],
}
#: Kinds of lodging and the words in a query that ask for them, in order of precedence.
LODGING = {
    "resort": ["resort", "khu nghỉ dưỡng", "retreat"],
    "homestay": ["homestay", "lodge", "cabin", "nhà dân", "farmstay", "glamping", "camping", "eco", "sinh_thái"],
    "villa": ["villa", "biệt thự", "bungalow"],
    "hostel": ["hostel"],
    "guesthouse": ["guesthouse", "nhà khách", "nhà nghỉ"],
    "aparthotel": ["aparthotel", "apartment hotel", "căn_hộ", "căn hộ dịch vụ"],
    "boutique_hotel": ["boutique", "boutique hotel"],
    "hotel": ["hotel", "khách sạn"],
}
#: Kinds of lodging and what a page or a name says of them, in order of precedence.
PAGE_LODGING = {
    "homestay": ["homestay"],
    "resort": ["resort", "khu nghỉ dưỡng"],
    "villa": ["villa", "biệt thự"],
    "hostel": ["hostel"],
    "guesthouse": ["guesthouse", "nhà khách"],
    "boutique_hotel": ["boutique"],
    "aparthotel": ["aparthotel", "apartment hotel"],
}
NAME_LODGING = {
    "homestay": ["homestay"],
    "resort": ["resort"],
    "villa": ["villa"],
    "hostel": ["hostel"],
    "guesthouse": ["guesthouse"],
    "boutique_hotel": ["boutique"],
    "aparthotel": ["aparthotel", "apartment", "căn hộ"],
}
TEXT_LODGING = {"resort": "resort", "homestay": "homestay", "villa": "villa", "hostel": "hostel", "guesthouse": "guesthouse", "aparthotel": "aparthotel", "boutique": "boutique_hotel", "hotel": "hotel"}

#: Words of a query's wishes that say nothing about a review.
EMPTY_WISHES = ["khách", "sạn", "khách sạn", "phòng", "rất", "có", "là", "và", "những", "cho", "tại", "ở", "của", "resort", "homestay", "villa", "khu nghỉ dưỡng", "chỗ nghỉ", "motel", "hostel", "boutique"]
VIEW_WORDS = ["view", "hướng", "nhìn"]
VIEW_PHRASES = ["view {}", "hướng {}", "nhìn ra {}", "nhìn {}", "thấy {}", "{} view"]

#: Intents that a complaint can conflict with, and the words that mean them.
CONFLICTS = {
    "cleanliness": ["sạch", "sạch sẽ", "vệ sinh"],
    "near_beach": ["biển", "gần biển", "view biển"],
    "pool": ["hồ bơi", "pool", "bể bơi"],
    "quiet_room": ["yên tĩnh", "cách âm", "ít ồn"],
    "near_center": ["trung tâm", "gần trung tâm"],
    "room_spacious": ["rộng", "rộng rãi", "thoáng"],
    "good_service": ["dịch vụ", "phục vụ", "nhân viên"],
    "food_quality": ["ăn sáng", "buffet", "đồ ăn"],
    "value": ["giá rẻ", "bình dân", "rẻ", "hợp lý"],
    "luxury": ["sang trọng", "cao cấp", "luxury", "5 sao", "đẳng cấp"],
    "family": ["gia đình", "trẻ em", "family", "kid"],
    "couple": ["lãng mạn", "cặp đôi", "honeymoon"],
    "pet": ["thú cưng", "chó", "mèo", "pet"],
    "view": ["view", "nhìn", "hướng", "cảnh", "ban công"],
    "airport": ["sân bay", "đưa đón", "gần sân bay"],
    "spa_gym": ["gym", "spa", "massage", "thể hình", "xông hơi", "fitness"],
    "kitchen": ["bếp", "nấu ăn", "bbq", "nướng", "bếp riêng"],
    "business": ["công tác", "business", "phòng họp", "meeting"],
}
#: Negative tags and the wishes that they go against.
UNWANTED = {
    "cleanliness": ["sạch", "sạch_sẽ", "vệ_sinh"],
    "breakfast": ["ăn_sáng", "bữa_sáng", "buffet", "điểm_tâm"],
    "food_quality": ["đồ_ăn", "ăn_ngon", "ẩm_thực", "nhà_hàng"],
    "pool": ["hồ_bơi", "bể_bơi", "pool"],
    "bathroom": ["phòng_tắm", "nhà_tắm", "toilet", "wc"],
    "staff_friendly": ["nhân_viên", "phục_vụ", "lễ_tân"],
    "room_spacious": ["phòng_rộng", "rộng_rãi", "giường_rộng"],
    "view_beach": ["view_biển", "hướng_biển"],
    "view_mountain": ["view_núi", "hướng_núi"],
    "near_center": ["trung_tâm", "gần_trung_tâm"],
    "near_beach": ["gần_biển", "ven_biển"],
    "quiet_room": ["yên_tĩnh", "ít_ồn", "cách_âm"],
    "convenience": ["tiện_nghi", "tiện_lợi", "thuận_tiện"],
    "good_service": ["dịch_vụ", "phục_vụ"],
    "ambiance": ["đẹp", "decor", "hiện_đại", "sống_ảo", "chụp_hình"],
}
#: Names of synonyms and the intents that they belong to.
SYNONYM_INTENTS = {
    "sạch sẽ": "cleanliness", "sạch": "cleanliness", "vệ sinh tốt": "cleanliness", "gọn gàng": "cleanliness",
    "yên tĩnh": "quiet_room", "ít ồn": "quiet_room", "tĩnh lặng": "quiet_room", "riêng tư": "quiet_room",
    "hồ bơi": "pool", "bể bơi": "pool", "pool": "pool", "swimming pool": "pool",
    "giá rẻ": "value", "bình dân": "value", "giá mềm": "value", "giá tốt": "value", "tiết kiệm": "value",
    "buffet sáng": "food_quality", "ăn sáng buffet": "food_quality", "bữa sáng buffet": "food_quality",
    "gần trung tâm": "near_center", "ngay trung tâm": "near_center", "sát trung tâm": "near_center", "thuận tiện đi lại": "near_center",
    "gia đình": "family", "cho trẻ em": "family", "đi cùng con nhỏ": "family",
    "cặp đôi": "couple", "honeymoon": "couple", "lãng mạn": "couple",
    "công tác": "business", "business": "business", "đi công tác": "business",
    "cao cấp": "luxury", "sang trọng": "luxury", "upscale": "luxury",
    "thân thiện": "good_service", "nhiệt tình": "good_service", "hiếu khách": "good_service",
    "gần sân bay": "airport", "sát sân bay": "airport",
    "bãi đậu xe": "convenience", "chỗ đậu xe": "convenience", "parking": "convenience", "đỗ xe": "convenience",
    "view đẹp": "view", "view biển": "view", "view núi": "view", "cảnh đẹp": "view", "góc nhìn đẹp": "view",
}
#: Parts of a context that make it negative whatever else it says.
STRONG_NEGATIVE = ["gián", "chuột", "rận", "bọ", "muỗi", "ruồi", "nhện", "mối", "mọt", "phân", "nước tiểu", "mùi hôi", "thối", "khủng khiếp", "kinh khủng", "ghê tởm", "ghê", "sợ", "ác mộng", "ám ảnh"]

#: Kinds of lodging as linked data declares them.
DECLARED_LODGING = {
    "hotel": "hotel", "homestay": "homestay", "resort": "resort", "villa": "villa", "hostel": "hostel", "guesthouse": "guesthouse",
    "boutiquehotel": "boutique_hotel", "boutique_hotel": "boutique_hotel", "boutique hotel": "boutique_hotel",
    "aparthotel": "aparthotel", "apartmenthotel": "aparthotel", "apartment hotel": "aparthotel", "apartment": "aparthotel",
}
#: Parts of an address in linked data, in order.
ADDRESS_PARTS = ["streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"]
